"""Aggregate functions: NULLs are passed over, and every one but count is NULL without values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import InvalidInput
from .scalar import NUMBERS, Typed, as_type

NAMES = ("avg", "count", "max", "min", "sum")


def aggregate(name: str, arg: Typed | None) -> Typed:
    """arg: None for count(*)."""
    if name == "count":
        return Typed(F.count(F.lit(1) if arg is None else arg.col), "INTEGER")
    if arg is None:
        raise InvalidInput(f"{name}(*) is not allowed")
    if name in ("min", "max"):
        return Typed((F.min if name == "min" else F.max)(arg.col), arg.type)
    if arg.type not in (*NUMBERS, None):
        raise InvalidInput(f"can't {name} {arg.type}")
    kind = arg.type or "INTEGER"
    c = as_type(arg, kind)
    if name == "sum":
        return Typed(F.sum(c), kind)
    if kind == "FLOAT":
        return Typed(F.avg(c), kind)
    # An average of integers is an integer: the quotient of sum and count, cut off.
    return Typed(F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0))), kind)
