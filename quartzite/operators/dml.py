"""INSERT, UPDATE and DELETE as DataFrames, checked before they are written.

Checks are set operations over the change and the snapshot: semi and anti
joins for keys and references, partial aggregates for uniqueness. Each yields
at most one row to the driver. A statement is atomic: nothing is written
unless all its checks pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..sources.schema import ColumnSpec, TableSpec
from ..sources.store import DELETED, Store, Transaction


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _undefined(c: ColumnSpec, col: Column | None = None) -> Column:
    """NULL or NaN: no key, never equal to another in a unique column."""
    col = _c(c.name) if col is None else col
    return col.isNull() | F.isnan(col) if c.type == "FLOAT" else col.isNull()


def normalized(spec: TableSpec, rows: DataFrame) -> DataFrame:
    """The columns of spec; -0.0 becomes 0.0."""
    return rows.select(*((_c(c.name) + F.lit(0.0) if c.type == "FLOAT" else _c(c.name)).alias(c.name) for c in spec.columns))


def _fail(found: DataFrame, message: str) -> None:
    row = found.limit(1).collect()
    if row:
        raise InvalidInput(message.format(*row[0]))


def check_rows(store: Store, txn: Transaction, spec: TableSpec, rows: DataFrame, after: DataFrame) -> None:
    """Rules of single rows and references of new rows. after: the table as it will be."""
    key = spec.key
    _fail(rows.where(_undefined(key)).select(_c(key.name)), "invalid primary key {}")
    for c in spec.columns:
        if not c.nullable and c.name != key.name:
            _fail(rows.where(_c(c.name).isNull()).select(F.lit(c.name)), "NULL value not allowed for column {}")
    for c in spec.columns:
        if not c.references:
            continue
        if c.type == "FLOAT":
            _fail(rows.where(F.isnan(_c(c.name))).select(_c(c.name)), f"reference {{}} not in table {c.references}")
        values = rows.select(_c(c.name).alias("value")).dropna()
        if c.references == spec.name:
            target, target_key = after, key.name
        else:
            other = store.table(txn, c.references)
            target, target_key = store.scan(txn, other), other.primary_key
        _fail(values.join(target.select(_c(target_key).alias("value")), "value", "left_anti"), f"reference {{}} not in table {c.references}")


def check_unique(spec: TableSpec, rows: DataFrame, after: DataFrame) -> None:
    """Unique columns in which a new value occurs more than once."""
    for c in spec.columns:
        if c.unique and c.name != spec.primary_key:
            new = rows.where(~_undefined(c)).select(_c(c.name).alias("value"))
            many = after.where(~_undefined(c)).select(_c(c.name).alias("value")).join(new.distinct(), "value", "left_semi")
            _fail(many.groupBy("value").count().where("count > 1"), f"value {{}} already in unique column {c.name}")


def _unique_columns(spec: TableSpec) -> list[str]:
    return [c.name for c in spec.columns if c.unique and c.name != spec.primary_key]


def insert(store: Store, txn: Transaction, spec: TableSpec, rows: DataFrame) -> int:
    """rows: the columns of spec."""
    store._writable(txn)
    rows = normalized(spec, rows)
    before = store.scan(txn, spec)
    key = spec.primary_key
    keys = rows.where(~_undefined(spec.key)).select(_c(key).alias("value"))
    _fail(keys.groupBy("value").count().where("count > 1"), "primary key {} already exists")
    _fail(keys.join(before.select(_c(key).alias("value")), "value", "left_semi"), "primary key {} already exists")
    after = before.unionByName(rows)
    check_rows(store, txn, spec, rows, after)
    check_unique(spec, rows, after)
    # A key that was deleted before has older rows, so it is only new to a table without any.
    known = any(k for _, _, k in store._parts(spec))
    return store.write(txn, spec, rows.withColumn(DELETED, F.lit(False)), known, _unique_columns(spec))


def _check_unreferenced(store: Store, txn: Transaction, spec: TableSpec, gone: DataFrame, with_self: bool) -> None:
    """gone: keys (column "value") that vanish. Rows of the same table that vanish too do not count as references."""
    for other in store.tables(txn):
        for c in other.columns:
            if c.references != spec.name or (other.name == spec.name and not with_self):
                continue
            child = store.scan(txn, other)
            if other.name == spec.name:
                child = child.join(gone.select(F.col("value").alias(spec.primary_key)), spec.primary_key, "left_anti")
            refs = child.select(_c(c.name).alias("value")).join(gone, "value", "left_semi")
            _fail(refs, f"row referenced by {other.name}.{c.name} = {{}}")


def delete(store: Store, txn: Transaction, spec: TableSpec, condition) -> int:
    """condition: DataFrame of the table to the DataFrame of the rows that go."""
    store._writable(txn)
    gone = condition(store.scan(txn, spec))
    _check_unreferenced(store, txn, spec, gone.select(_c(spec.primary_key).alias("value")), True)
    return store.write(txn, spec, gone.withColumn(DELETED, F.lit(True)), True)


def update(store: Store, txn: Transaction, spec: TableSpec, changed: DataFrame, moves: bool) -> int:
    """changed: old_key(spec) and the columns of spec, for every row that the statement touches."""
    store._writable(txn)
    key = spec.primary_key
    before = store.scan(txn, spec)
    old = old_key(spec)
    changed = changed.select(F.col(old), *((_c(c.name) + F.lit(0.0) if c.type == "FLOAT" else _c(c.name)).alias(c.name) for c in spec.columns))
    rows = changed.drop(old)
    kept = before.join(changed.select(F.col(old).alias(key)), key, "left_anti").select(*(_c(c.name) for c in spec.columns))
    after = kept.unionByName(rows)
    out = rows.withColumn(DELETED, F.lit(False))
    if moves:
        _fail(changed.where(_undefined(spec.key)).select(_c(key)), "invalid primary key {}")
        _check_moves(key, old, changed, before)
        vacated = changed.select(F.col(old).alias(key)).join(rows.select(_c(key)), key, "left_anti")
        _check_unreferenced(store, txn, spec, vacated.select(_c(key).alias("value")), False)
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else _c(key) for f in spec.struct().fields]
        out = out.unionByName(vacated.select(*nothing).withColumn(DELETED, F.lit(True)))
    check_rows(store, txn, spec, rows, after)
    check_unique(spec, rows, after)
    n = changed.count()
    store.write(txn, spec, out, True, _unique_columns(spec))
    return n


def old_key(spec: TableSpec) -> str:
    """The name of the column with a changed row's former key."""
    name = "old_key"
    while any(c.name == name for c in spec.columns):
        name += "_"
    return name


def _check_moves(key: str, old: str, changed: DataFrame, before: DataFrame) -> None:
    """Rows move in order of their old keys, one by one; a row may take a key only if it is free by then."""
    _fail(changed.groupBy(_c(key).alias("value")).count().where("count > 1"), "primary key {} already exists")
    m = changed.select(F.col(old).alias("from"), _c(key).alias("to"))
    moved = m.where(F.col("from") != F.col("to"))
    holder = m.select(F.col("from").alias("holder"), F.col("to").alias("holder_to"))
    taken = moved.join(before.select(_c(key).alias("to")), "to", "left_semi").join(holder, F.col("to") == F.col("holder"), "left")
    free = F.col("holder").isNotNull() & (F.col("holder") < F.col("from")) & (F.col("holder_to") != F.col("holder"))
    _fail(taken.where(~free).select("to"), "primary key {} already exists")
