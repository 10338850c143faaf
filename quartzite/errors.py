"""Errors that statements raise."""


class Error(Exception):
    """Base of all errors of the engine."""


class Abort(Error):
    """The operation was given up and may be tried again."""

    def __init__(self, message: str = "operation aborted"):
        super().__init__(message)


class InvalidData(Error):
    """Stored data that cannot be read."""


class InvalidInput(Error):
    """A statement or a value that is not allowed."""


class ReadOnly(Error):
    """A write in a read-only transaction."""

    def __init__(self, message: str = "read-only transaction"):
        super().__init__(message)


class Serialization(Error):
    """A write that conflicts with a concurrent transaction."""

    def __init__(self, message: str = "serialization failure, retry transaction"):
        super().__init__(message)
