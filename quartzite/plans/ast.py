"""Syntax trees. Nodes are immutable and equal if they are written alike."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    """A constant of type BOOLEAN, INTEGER, FLOAT, STRING or, for NULL, None. Floats are held as repr, so NaN equals NaN."""

    value: object
    type: str | None


@dataclass(frozen=True)
class Column(Expr):
    table: str | None
    name: str


@dataclass(frozen=True)
class Star(Expr):
    """`*` among select items and in count(*)."""


@dataclass(frozen=True)
class Operator(Expr):
    """Prefix, infix and postfix operators alike, by name."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: TableRef | Join
    right: TableRef
    kind: str
    on: Expr | None


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr, str | None], ...]
    sources: tuple[TableRef | Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[tuple[Expr, bool], ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    #: Column to expression, or to None for DEFAULT.
    changes: tuple[tuple[str, Expr | None], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    nullable: bool | None = None
    default: Expr | None = None
    unique: bool = False
    index: bool = False
    references: str | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool


@dataclass(frozen=True)
class Begin:
    read_only: bool
    as_of: int | None


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


@dataclass(frozen=True)
class Explain:
    statement: object
