"""Syntax trees to DataFrames: names, types and clauses; Catalyst does the rest.

Every column of an intermediate DataFrame has a name of its own, so duplicate
and missing labels never confuse Spark; labels are put on by the last select.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import aggregate as aggregates
from ..functions import scalar
from ..functions.scalar import Typed
from . import ast

_numbers = itertools.count()
#: Pairs of rows that a task of a join without equal keys compares, rows from which the smaller side is worth dealing out, and most tasks.
PAIRS, FEWEST, TASKS = 2**26, 256, 10_000
SPARK_TO_DIALECT = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "FLOAT", "double": "FLOAT", "string": "STRING"}


def unique() -> str:
    return f"q{next(_numbers)}"


@dataclass
class Field:
    """A column in scope: labels, internal name and type (a dialect type, or Spark's name of any other)."""

    table: str | None
    name: str | None
    internal: str
    type: str | None


@dataclass
class Source:
    """A table as the analyzer sees it: its rows and its primary key, if any."""

    df: DataFrame
    primary_key: str | None = None


@dataclass
class Scope:
    fields: list[Field] = field(default_factory=list)
    tables: set[str] = field(default_factory=set)
    #: Computed expressions by syntax tree: group keys and aggregates.
    computed: dict[ast.Expr, Field] = field(default_factory=dict)
    grouped: bool = False
    #: How many rows the DataFrame has: tables are counted, joins guessed from their sides.
    rows: Callable[[DataFrame], int] = DataFrame.count

    def merged(self, other: Scope) -> Scope:
        for t in sorted(other.tables & self.tables):
            raise InvalidInput(f"duplicate table name {t}")
        return Scope(self.fields + other.fields, self.tables | other.tables)

    def hides(self, e: ast.Expr) -> bool:
        """Whether a name stands for something other than what was computed for it."""
        return False

    def find(self, c: ast.Column) -> Field:
        if c.table is not None and self.tables and c.table not in self.tables:
            raise InvalidInput(f"unknown table {c.table}")
        if not self.fields and not self.grouped:
            raise InvalidInput(f"expression must be constant, found column {_written(c)}")
        found = [f for f in self.fields if f.name == c.name and c.table in (None, f.table)]
        if len({f.internal for f in found}) > 1:
            raise InvalidInput(f"ambiguous column {c.name}")
        if found:
            return found[0]
        if self.grouped:
            raise InvalidInput(f"column {_written(c)} must be used in an aggregate or GROUP BY expression")
        raise InvalidInput(f"unknown column {_written(c)}")


def _written(c: ast.Column) -> str:
    return c.name if c.table is None else f"{c.table}.{c.name}"


def compile_(e: ast.Expr, scope: Scope) -> Typed:
    if e in scope.computed and not scope.hides(e):
        f = scope.computed[e]
        return Typed(F.col(f.internal), f.type)
    if isinstance(e, ast.Literal):
        return scalar.literal(e.value, e.type)
    if isinstance(e, ast.Column):
        f = scope.find(e)
        return Typed(F.col(f.internal), f.type)
    if isinstance(e, ast.Operator):
        return scalar.OPERATORS[e.name](*(compile_(a, scope) for a in e.args))
    if isinstance(e, ast.Call):
        if e.name in aggregates.NAMES:
            raise InvalidInput("aggregate functions can't be used here" if not scope.grouped else "aggregate functions can't be nested")
        if e.name == "sqrt" and len(e.args) == 1:
            return scalar.sqrt(compile_(e.args[0], scope))
        raise InvalidInput(f"unknown function {e.name} with {len(e.args)} arguments")
    raise InvalidInput("* can't be used here")


def predicate(e: ast.Expr, scope: Scope) -> Column:
    t = compile_(e, scope)
    if t.type not in ("BOOLEAN", None):
        raise InvalidInput(f"filter returned {t.type}, expected boolean")
    return scalar.as_type(t, "BOOLEAN")


def standardized(df: DataFrame) -> tuple[DataFrame, list[Field]]:
    """The columns of a table under internal names, numbers as bigint and double."""
    columns, fields = [], []
    for name, kind in df.dtypes:
        type_ = SPARK_TO_DIALECT.get(kind, kind)
        internal = unique()
        c = F.col(f"`{name}`")
        columns.append((c.cast(scalar.SPARK_TYPES[type_]) if type_ in scalar.SPARK_TYPES and kind != scalar.SPARK_TYPES[type_] else c).alias(internal))
        fields.append(Field(None, name, internal, type_))
    return df.select(*columns), fields


def _walk(e: ast.Expr):
    yield e
    for a in getattr(e, "args", ()):
        yield from _walk(a)


def _terms(e: ast.Expr | None) -> tuple[ast.Expr, ...]:
    """What AND holds together."""
    if isinstance(e, ast.Operator) and e.name == "and":
        return tuple(t for a in e.args for t in _terms(a))
    return () if e is None else (e,)


def _columns(e: ast.Expr) -> list[ast.Column]:
    return [c for c in _walk(e) if isinstance(c, ast.Column)]


def _within(e: ast.Expr, scope: Scope) -> bool:
    """Whether the expression has columns, all of this scope, and no aggregates."""
    try:
        return bool(_columns(e)) and not aggregate_calls(e) and all(scope.find(c) for c in _columns(e))
    except InvalidInput:
        return False


def _keyed(terms: tuple[ast.Expr, ...], left: Scope, right: Scope, cross: bool) -> bool:
    """Whether terms give the sides equal keys, directly or by a table yet to be joined; a cross join may also be put off until after that."""
    further = [False, False]
    for e in terms:
        if isinstance(e, ast.Operator) and e.name == "=":
            for a, b in (e.args, e.args[::-1]):
                for i, (here, there) in enumerate(((left, right), (right, left))):
                    if _within(a, here) and _columns(b):
                        if _within(b, there):
                            return True
                        further[i] |= not _within(b, here)
    return any(further) if cross else all(further)


def blocks(left: int, right: int) -> tuple[int, int]:
    """Into how many blocks of rows to deal either side, so that a pair of blocks has about PAIRS pairs of rows, or 1 / TASKS of all if that is more."""
    each = max(PAIRS, math.ceil(left * right / TASKS))
    side = math.isqrt(each)
    n, m = math.ceil(left / side), math.ceil(right / side)
    if n == 1 or m == 1:
        n, m = (math.ceil(left * right / each), 1) if m == 1 else (1, math.ceil(left * right / each))
    return n, m


def _block(df: DataFrame, n: int, first: Callable[[Column], Column], step: int, copies: int, cells: int) -> tuple[DataFrame, str]:
    """Each row dealt to one of n blocks, evenly whatever it holds, and copied to the cells of its block: first(block), and so on by step. With the cell's name."""
    block, cell = unique(), unique()
    df = df.repartition(n).withColumn(block, F.spark_partition_id() % n)
    start = first(F.col(block))
    df = df.withColumn(cell, F.explode(F.sequence(start, start + (copies - 1) * step, F.lit(step)))).drop(block)
    return df.repartitionById(cells, cell), cell


def aggregate_calls(e: ast.Expr) -> list[ast.Call]:
    found = [x for x in _walk(e) if isinstance(x, ast.Call) and x.name in aggregates.NAMES]
    for call in found:
        if len(call.args) != 1:
            raise InvalidInput(f"{call.name} takes one argument")
        if any(isinstance(x, ast.Call) and x.name in aggregates.NAMES for x in _walk(call.args[0])):
            raise InvalidInput("aggregate functions can't be nested")
    return found


class Analyzer:
    """tables: the source of a table name, or an error if it does not exist."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], Source]):
        self.spark, self.tables = spark, tables
        self.counts: dict[str, int] = {}

    def table(self, ref: ast.TableRef) -> tuple[DataFrame, Scope, list[str]]:
        source = self.tables(ref.name)
        label = ref.alias or ref.name
        df, fields = standardized(source.df)
        for f in fields:
            f.table = label
        key = [f.internal for f in fields if f.name == source.primary_key]

        def rows(d: DataFrame) -> int:
            if d is not df:
                return d.count()
            # A table that is joined with itself is counted once.
            if ref.name not in self.counts:
                self.counts[ref.name] = d.count()
            return self.counts[ref.name]

        return df, Scope(fields, {label}, rows=rows), key

    def source(self, s: ast.TableRef | ast.Join, terms: tuple[ast.Expr, ...] = ()) -> tuple[DataFrame, Scope, list[str]]:
        """terms: what else must hold for rows to count."""
        if isinstance(s, ast.TableRef):
            return self.table(s)
        terms, above = terms + _terms(s.on), terms
        left, left_scope, left_key = self.source(s.left, {"left": above, "right": ()}.get(s.kind, terms))
        right, right_scope, right_key = self.table(s.right)
        df, scope = self.joined(left, left_scope, right, right_scope, s.kind, s.on, terms)
        return df, scope, left_key + right_key

    def joined(self, left: DataFrame, left_scope: Scope, right: DataFrame, right_scope: Scope, kind: str, on: ast.Expr | None, terms: tuple[ast.Expr, ...]) -> tuple[DataFrame, Scope]:
        """A join; one without equal keys is cut into tasks of bounded work: Spark would leave a small file's pairs, however many, to one task.

        terms: what must hold for rows to count, ON included. Inner joins pair
        blocks of both sides; outer ones deal out the side that keeps its rows.
        """
        scope = left_scope.merged(right_scope)
        condition = None if on is None else predicate(on, scope)
        whole = left.crossJoin(right) if condition is None else left.join(right, condition, kind)
        if _keyed(terms, left_scope, right_scope, kind == "cross"):
            scope.rows = lambda _: max(left_scope.rows(left), right_scope.rows(right))
            return whole, scope
        one, two = left, right
        if kind in ("inner", "cross"):
            # Spark pushes no filter through the blocks, and only rows that pass are to be counted and dealt.
            for e in terms:
                one = one.where(predicate(e, left_scope)) if _within(e, left_scope) else one
                two = two.where(predicate(e, right_scope)) if _within(e, right_scope) else two
        counts = left_scope.rows(one), right_scope.rows(two)
        scope.rows = lambda _: math.prod(counts)
        n, m = blocks(*counts) if min(counts) >= FEWEST else (1, 1)
        if n * m == 1:
            return whole, scope
        if kind == "left":
            return left.repartition(n * m).join(right, condition, kind), scope
        if kind == "right":
            return left.join(right.repartition(n * m), condition, kind), scope
        one, a = _block(one, n, lambda i: i * m, 1, m, n * m)
        two, b = _block(two, m, lambda i: i, m, n, n * m)
        same = F.col(a) == F.col(b)
        # By merging: a broadcast would bring the copies of a whole side to every executor.
        return one.hint("merge").join(two, same if condition is None else same & condition), scope

    def select(self, s: ast.Select) -> DataFrame:
        df, scope, keys = self.spark.range(1).select(), Scope(), []
        for i, item in enumerate(s.sources):
            other, other_scope, other_keys = self.source(item, _terms(s.where))
            df, scope = self.joined(df, scope, other, other_scope, "cross", None, _terms(s.where)) if i else (other, other_scope)
            keys += other_keys
        if s.where is not None:
            self._no_aggregates(s.where, "WHERE")
            df = df.where(predicate(s.where, scope))
        items = self._expanded(s, scope)
        calls = [c for e in (*(e for e, _ in items), *([s.having] if s.having is not None else ()), *(e for e, _ in s.order_by)) for c in aggregate_calls(e)]
        if s.having is not None and not s.group_by and not calls:
            raise InvalidInput("HAVING requires GROUP BY or aggregate function")
        if s.group_by or calls:
            df, scope, keys = self._aggregated(df, scope, s.group_by, calls)
        df, out, labels = self._projected(df, scope, items)
        after = self._after(scope, out, labels, items)
        if s.having is not None:
            df = df.where(predicate(s.having, after))
        order = []
        for e, down in s.order_by:
            c = compile_(e, after)
            # A bare literal would be taken for a position; NULL has no order.
            if c.type is not None and not isinstance(e, ast.Literal):
                order.append(c.col.desc() if down else c.col.asc())
        offset, limit = (self._count(e, what) for e, what in ((s.offset, "OFFSET"), (s.limit, "LIMIT")))
        if order or offset or limit is not None:
            # Ties, and rows without any order, keep the order of the primary keys or groups.
            order += [F.col(k) for k in keys]
        if order:
            df = df.orderBy(*order)
        if offset:
            df = df.limit(0) if self._beyond(df, offset, "OFFSET") else df.offset(offset)
        if limit is not None and not self._beyond(df, limit, "LIMIT"):
            df = df.limit(limit)
        return df.select(*(F.col(f.internal).alias(label if label is not None else "?") for f, label in zip(out, labels, strict=True)))

    def _no_aggregates(self, e: ast.Expr, where: str) -> None:
        if aggregate_calls(e):
            raise InvalidInput(f"aggregate functions not allowed in {where}")

    def _expanded(self, s: ast.Select, scope: Scope) -> list[tuple[ast.Expr, str | None]]:
        items: list[tuple[ast.Expr, str | None]] = []
        for e, alias in s.items:
            if isinstance(e, ast.Star):
                if not s.sources:
                    raise InvalidInput("SELECT * requires a FROM clause")
                items += [(ast.Column(f.table, f.name), None) for f in scope.fields]
            else:
                items.append((e, alias))
        return items

    def _aggregated(self, df: DataFrame, scope: Scope, group_by: tuple[ast.Expr, ...], calls: list[ast.Call]) -> tuple[DataFrame, Scope, list[str]]:
        after = Scope(tables=scope.tables, grouped=True)
        keys, values = [], []
        for e in dict.fromkeys(group_by):
            if isinstance(e, ast.Star):
                raise InvalidInput("* can't be used in GROUP BY")
            self._no_aggregates(e, "GROUP BY")
            t = compile_(e, scope)
            f = Field(None, None, unique(), t.type)
            if isinstance(e, ast.Column):
                old = scope.find(e)
                f = Field(old.table, old.name, f.internal, t.type)
            keys.append((t.col if t.type else t.col.cast("boolean")).alias(f.internal))
            after.fields.append(f)
            after.computed[e] = f
        for call in dict.fromkeys(calls):
            arg = call.args[0]
            t = aggregates.aggregate(call.name, None if isinstance(arg, ast.Star) else compile_(arg, scope))
            f = Field(None, None, unique(), t.type)
            values.append(t.col.alias(f.internal))
            after.computed[call] = f
        names = [f.internal for f in after.fields]
        if not keys:
            df = df.agg(*values)
        else:
            # Keys are columns first: a literal among grouping expressions would be taken for a position.
            df = df.withColumns({n: k for n, k in zip(names, keys, strict=True)})
            df = df.groupBy(*names).agg(*values) if values else df.select(*names).distinct()
        return df, after, names

    def _projected(self, df: DataFrame, scope: Scope, items: list[tuple[ast.Expr, str | None]]) -> tuple[DataFrame, list[Field], list[str | None]]:
        out, labels, new = [], [], {}
        for e, alias in items:
            t = compile_(e, scope)
            label, table = alias, None
            if alias is None and isinstance(e, ast.Column):
                f = scope.find(e)
                label, table = f.name, f.table
            internal = unique()
            # An untyped NULL has no column type of its own in files.
            new[internal] = t.col if t.type else t.col.cast("string")
            out.append(Field(table, label, internal, t.type))
            labels.append(label)
        return df.withColumns(new), out, labels

    def _after(self, scope: Scope, out: list[Field], labels: list[str | None], items: list[tuple[ast.Expr, str | None]]) -> Scope:
        """For HAVING and ORDER BY: aliases and bare columns of the output first, then what the input has."""
        aliases: dict[str, Field] = {}
        doubled = set()
        for f, (e, alias) in zip(out, items, strict=True):
            if alias is not None:
                if alias in aliases:
                    doubled.add(alias)
                aliases[alias] = f
        hidden = [f for f in scope.fields if f.name not in aliases] + [
            Field(f.table, f.name, f.internal, f.type) for f in scope.fields if f.name in aliases and f.table is not None
        ]
        after = _After(hidden, set(scope.tables), dict(scope.computed), scope.grouped)
        after.aliases, after.doubled = aliases, doubled
        return after

    def _count(self, e: ast.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        t = compile_(e, Scope())
        if t.type != "INTEGER":
            raise InvalidInput(f"invalid {what} {t.type or 'NULL'}")
        n = t.constant[0] if t.constant else self.spark.range(1).select(t.col).first()[0]
        if n is None or n < 0:
            raise InvalidInput(f"invalid {what} {n}")
        return n


    def _beyond(self, df: DataFrame, n: int, what: str) -> bool:
        """Whether n, more than Spark can count off, is no less than all the rows there are; an error if it cuts them."""
        if n < 2**31:
            return False
        if df.count() > n:
            raise InvalidInput(f"{what} {n} of a larger result is not supported")
        return True


@dataclass
class _After(Scope):
    """A scope in which an alias hides columns of its name, unless these are qualified."""

    aliases: dict[str, Field] = field(default_factory=dict)
    doubled: set[str] = field(default_factory=set)

    def hides(self, e: ast.Expr) -> bool:
        return isinstance(e, ast.Column) and e.table is None and e.name in self.aliases

    def find(self, c: ast.Column) -> Field:
        if c.table is None and c.name in self.doubled:
            raise InvalidInput(f"ambiguous column {c.name}")
        if c.table is None and c.name in self.aliases:
            return self.aliases[c.name]
        return super().find(c)
