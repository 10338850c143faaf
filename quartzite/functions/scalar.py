"""Operators of the dialect over typed Spark columns.

Four types (BOOLEAN, INTEGER as bigint, FLOAT as double, STRING) and the
untyped NULL. INTEGER and FLOAT mix; nothing else is coerced. Integer
arithmetic relies on ANSI mode for overflow and division errors; float
arithmetic is IEEE, with NaN unequal to everything in comparisons. All of it
stays in built-in expressions, so whole-stage code generation and pushdown
remain possible.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput

SPARK_TYPES = {"BOOLEAN": "boolean", "INTEGER": "bigint", "FLOAT": "double", "STRING": "string"}
NUMBERS = ("INTEGER", "FLOAT")


class Typed(NamedTuple):
    """A column with its dialect type (None for NULL) and, for constants, its value in a one-tuple."""

    col: Column
    type: str | None
    constant: tuple | None = None


def literal(value, type_: str | None) -> Typed:
    if type_ == "FLOAT":
        value = float(value)
        text = {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, "NaN" if math.isnan(value) else None)
        return Typed(F.lit(text or value).cast("double"), type_, (value,))
    return Typed(F.lit(value).cast(SPARK_TYPES[type_]) if type_ else F.lit(None), type_, (value,))


def as_type(x: Typed, type_: str | None) -> Column:
    """The column in a type: NULL takes any, INTEGER may widen to FLOAT."""
    if x.type == type_:
        return x.col
    if x.type is None or (x.type, type_) == ("INTEGER", "FLOAT"):
        return x.col.cast(SPARK_TYPES[type_])
    raise InvalidInput(f"can't use {x.type} as {type_}")


def _refuse(verb: str, *args: Typed) -> InvalidInput:
    return InvalidInput(f"can't {verb} {' and '.join(a.type or 'NULL' for a in args)}")


def _numbers(verb: str, *args: Typed) -> tuple[str, list[Column]]:
    """The common number type, and the columns in it. With NULLs alone, INTEGER."""
    if any(a.type not in (*NUMBERS, None) for a in args):
        raise _refuse(verb, *args)
    kind = "FLOAT" if any(a.type == "FLOAT" for a in args) else "INTEGER"
    return kind, [as_type(a, kind) for a in args]


def _booleans(verb: str, *args: Typed) -> list[Column]:
    if any(a.type not in ("BOOLEAN", None) for a in args):
        raise _refuse(verb, *args)
    return [as_type(a, "BOOLEAN") for a in args]


def and_(a: Typed, b: Typed) -> Typed:
    x, y = _booleans("and", a, b)
    return Typed(x & y, "BOOLEAN")


def or_(a: Typed, b: Typed) -> Typed:
    x, y = _booleans("or", a, b)
    return Typed(x | y, "BOOLEAN")


def not_(a: Typed) -> Typed:
    return Typed(~_booleans("not", a)[0], "BOOLEAN")


def _comparable(a: Typed, b: Typed) -> tuple[str, Column, Column]:
    if a.type in NUMBERS and b.type in NUMBERS:
        kind, (x, y) = _numbers("compare", a, b)
        return kind, x, y
    kind = a.type or b.type or "BOOLEAN"
    if a.type not in (kind, None) or b.type not in (kind, None):
        raise _refuse("compare", a, b)
    return kind, (as_type(a, kind) if kind in SPARK_TYPES else a.col), (as_type(b, kind) if kind in SPARK_TYPES else b.col)


def _ieee(result: Column, x: Column, y: Column, kind: str, *sides: Typed) -> Column:
    """FALSE instead of Spark's answer where a side that may be NaN is NaN and neither is NULL."""
    if kind != "FLOAT":
        return result
    for c, other, s in ((x, y, sides[0]), (y, x, sides[1])):
        finite = s.constant and (s.constant[0] is None or not math.isnan(s.constant[0]))
        if s.type == "FLOAT" and not finite:
            # A conjunction, not a CASE, so that the comparison can still be pushed down and extracted as a join key.
            result = result & (~F.isnan(c) | other.isNull())
    return result


def equal(a: Typed, b: Typed) -> Typed:
    kind, x, y = _comparable(a, b)
    return Typed(_ieee(x == y, x, y, kind, a, b), "BOOLEAN")


def greater(a: Typed, b: Typed) -> Typed:
    kind, x, y = _comparable(a, b)
    return Typed(_ieee(x > y, x, y, kind, a, b), "BOOLEAN")


def less(a: Typed, b: Typed) -> Typed:
    return greater(b, a)


def at_least(a: Typed, b: Typed) -> Typed:
    kind, x, y = _comparable(a, b)
    return Typed(_ieee(x >= y, x, y, kind, a, b), "BOOLEAN")


def at_most(a: Typed, b: Typed) -> Typed:
    return at_least(b, a)


def is_null(a: Typed) -> Typed:
    return Typed(a.col.isNull(), "BOOLEAN")


def is_nan(a: Typed) -> Typed:
    if a.type not in ("FLOAT", None):
        raise InvalidInput(f"IS NAN can't be used with {a.type}")
    c = as_type(a, "FLOAT")
    return Typed(F.when(c.isNotNull(), F.isnan(c)), "BOOLEAN")


def add(a: Typed, b: Typed) -> Typed:
    kind, (x, y) = _numbers("add", a, b)
    return Typed(x + y, kind)


def subtract(a: Typed, b: Typed) -> Typed:
    kind, (x, y) = _numbers("subtract", a, b)
    return Typed(x - y, kind)


def multiply(a: Typed, b: Typed) -> Typed:
    kind, (x, y) = _numbers("multiply", a, b)
    return Typed(x * y, kind)


def divide(a: Typed, b: Typed) -> Typed:
    kind, (x, y) = _numbers("divide", a, b)
    if kind == "INTEGER":
        return Typed(F.call_function("div", x, y), kind)
    # pow(0.0, -1) is infinity with the sign of its zero, where x / 0.0 would raise.
    return Typed(F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y), kind)


def remainder(a: Typed, b: Typed) -> Typed:
    kind, (x, y) = _numbers("take remainder of", a, b)
    if kind == "INTEGER":
        return Typed(x % y, kind)
    nan = F.lit("NaN").cast("double")
    return Typed(F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, nan).otherwise(x % y), kind)


def power(a: Typed, b: Typed) -> Typed:
    """Integers to a non-negative power are exact; a constant negative exponent gives a FLOAT, a varying one raises."""
    kind, (x, y) = _numbers("exponentiate", a, b)
    if kind == "FLOAT" or (b.constant and b.constant[0] is not None and b.constant[0] < 0):
        return Typed(F.pow(x.cast("double"), y.cast("double")), "FLOAT")
    one, too_large = F.lit(1).cast("bigint"), F.raise_error(F.lit("integer overflow")).cast("bigint")
    product = F.aggregate(F.array_repeat(x, y.cast("int")), one, lambda p, v: p * v)
    return Typed(
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("bigint"))
        .when(y < 0, F.raise_error(F.lit("negative exponent of an integer column")).cast("bigint"))
        .when((x == 1) | (y == 0), one)
        .when(x == 0, x)
        .when(x == -1, F.when(y % 2 == 0, one).otherwise(-one))
        .when(y > 63, too_large)
        .otherwise(product),
        "INTEGER",
    )


def factorial(a: Typed) -> Typed:
    if a.type not in ("INTEGER", None):
        raise _refuse("take factorial of", a)
    c = as_type(a, "INTEGER")
    bad = F.when(c < 0, F.lit("can't take factorial of negative number")).otherwise(F.lit("integer overflow"))
    return Typed(F.when((c < 0) | (c > 20), F.raise_error(bad).cast("bigint")).otherwise(F.factorial(c.cast("int"))), "INTEGER")


def identity(a: Typed) -> Typed:
    if a.type not in (*NUMBERS, None):
        raise _refuse("take the identity of", a)
    return a


def negate(a: Typed) -> Typed:
    if a.type not in (*NUMBERS, None):
        raise _refuse("negate", a)
    if a.type is None:
        return a
    if a.constant and a.constant[0] is not None:
        return literal(-a.constant[0], a.type)
    return Typed(-a.col, a.type)


def like(a: Typed, b: Typed) -> Typed:
    """% is any run, _ any one character; nothing escapes: the escape character is a code point that is no character."""
    if any(x.type not in ("STRING", None) for x in (a, b)):
        raise _refuse("LIKE", a, b)
    return Typed(F.like(as_type(a, "STRING"), as_type(b, "STRING"), F.lit("￿")), "BOOLEAN")


def sqrt(a: Typed) -> Typed:
    if a.type not in (*NUMBERS, None):
        raise _refuse("take square root of", a)
    c = as_type(a, "FLOAT")
    if a.type == "INTEGER":
        negative = F.raise_error(F.lit("can't take square root of negative number")).cast("double")
        return Typed(F.when(a.col < 0, negative).otherwise(F.sqrt(c)), "FLOAT")
    return Typed(F.sqrt(c), "FLOAT")


def _not_equal(a: Typed, b: Typed) -> Typed:
    return not_(equal(a, b))


OPERATORS = {
    "and": and_,
    "or": or_,
    "not": not_,
    "=": equal,
    "!=": _not_equal,
    ">": greater,
    "<": less,
    ">=": at_least,
    "<=": at_most,
    "is null": is_null,
    "is nan": is_nan,
    "+": add,
    "-": subtract,
    "*": multiply,
    "/": divide,
    "%": remainder,
    "^": power,
    "!": factorial,
    "identity": identity,
    "negate": negate,
    "like": like,
}
