"""Engine and Session: statements, transactions and results."""

from __future__ import annotations

import atexit
import contextlib
import random
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Abort, InvalidInput, Serialization
from .functions import scalar
from .operators import dml
from .plans import ast
from .plans.analyzer import Analyzer, Scope, Source, compile_, predicate, standardized
from .plans.parser import parse
from .sources import schema
from .sources.schema import TableSpec
from .sources.store import Store, Transaction


@dataclass
class Result:
    """What a statement gave: kind, and what belongs to it."""

    kind: str
    df: DataFrame | None = None
    count: int | None = None
    transaction: Transaction | None = None
    text: str | None = None
    name: str | None = None
    existed: bool | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[tuple]:
        """All rows, on the driver."""
        if self.df is None:
            raise InvalidInput(f"{self.kind} has no rows")
        return [tuple(r) for r in self.df.collect()]

    def one(self) -> tuple:
        if self.df is None:
            raise InvalidInput(f"{self.kind} has no rows")
        found = self.df.head(1)
        if not found:
            raise InvalidInput("no rows returned")
        return tuple(found[0])

    def scalar(self):
        return self.one()[0]

    def _as(self, kind: type, name: str):
        """The only value of the only row, which must be of this type."""
        got = self.df.head(2) if self.df is not None else []
        if len(got) != 1 or len(got[0]) != 1:
            raise InvalidInput(f"{self.kind} has not exactly one value")
        if type(got[0][0]) is not kind:
            raise InvalidInput(f"not {name}: {got[0][0]!r}")
        return got[0][0]

    def boolean(self) -> bool:
        return self._as(bool, "a boolean")

    def integer(self) -> int:
        return self._as(int, "an integer")

    def floating(self) -> float:
        return self._as(float, "a float")

    def string(self) -> str:
        return self._as(str, "a string")


@dataclass
class Engine:
    """Tables of a versioned store (root: its folder, on any file system that Spark reaches), and external read-only ones.

    The Spark session is the caller's; ANSI mode, on which overflow errors rest, is switched on.
    """

    spark: SparkSession
    root: str | None = None
    external: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    #: On opening, tables whose stored rows are stale to this share or more are compacted; None: none are.
    compact_at: float | None = None

    def __post_init__(self):
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.store = Store(self.spark, self.root) if self.root else None
        if self.store and self.compact_at is not None:
            self.compact(self.compact_at)

    @classmethod
    def temporary(cls, spark: SparkSession) -> Engine:
        """An engine for tests and embedded use on one machine: its store is gone when the process ends."""
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidInput("a temporary store needs a Spark session on one machine")
        folder = tempfile.TemporaryDirectory(prefix="quartzite-")
        atexit.register(folder.cleanup)
        return cls(spark, f"file://{folder.name}/store")

    def compact(self, share: float = 0.0) -> list[str]:
        """Compact the tables with this share of stale rows or more, while no transaction is active; the names of those that were."""
        done = []
        for spec in self.store.tables(self.store.begin(True)):
            if (stale := self.store.garbage(spec)) > 0 and stale >= share:
                with contextlib.suppress(Abort, Serialization):  # somebody writes: it can wait
                    self.store.compact(spec)
                    done.append(spec.name)
        return done

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a read-only table without a primary key."""
        self.external[name] = df

    def register_parquet(self, folder: str, names: list[str]) -> Engine:
        """Make Parquet files of a folder read-only tables; each is opened when a statement first names it."""
        for n in names:
            self.external[n] = lambda n=n: self.spark.read.parquet(f"{folder}/{n}.parquet")
        return self

    def external_table(self, name: str) -> DataFrame:
        df = self.external[name]
        if not isinstance(df, DataFrame):
            df = self.external[name] = df()
        return df

    def session(self) -> Session:
        return Session(self)

    def status(self) -> dict:
        """Versions, active transactions and the folder of the store."""
        if self.store is None:
            raise InvalidInput("the engine has no store")
        return self.store.status()

    def with_retry(self, work: Callable, retries: int = 10, least_s: float = 0.01, most_s: float = 2.0):
        """work() again, after a random and growing wait, while it fails by conflict."""
        for attempt in range(retries + 1):
            try:
                return work()
            except (Serialization, Abort):
                if attempt == retries:
                    raise
                time.sleep(random.uniform(0, min(most_s, least_s * 2**attempt)))


class Session:
    """One client: at most one transaction open at a time; closing rolls it back."""

    def __init__(self, engine: Engine):
        self.engine, self.txn = engine, None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.txn is not None:
            txn, self.txn = self.txn, None
            self.engine.store.rollback(txn)

    def execute(self, sql: str) -> Result:
        return self.run(parse(sql))

    def sql(self, text: str) -> DataFrame:
        """The rows of a SELECT, lazily."""
        return self.execute(text).df

    def run(self, s) -> Result:
        if isinstance(s, ast.Begin):
            if self.txn is not None:
                raise InvalidInput("already in a transaction")
            self.txn = self._store().begin(s.read_only, s.as_of)
            return Result("BEGIN", transaction=self.txn)
        if isinstance(s, (ast.Commit, ast.Rollback)):
            if self.txn is None:
                raise InvalidInput("not in a transaction")
            txn, self.txn = self.txn, None
            commit = isinstance(s, ast.Commit)
            (self._store().commit if commit else self._store().rollback)(txn)
            return Result("COMMIT" if commit else "ROLLBACK", transaction=txn)
        if isinstance(s, ast.Explain):
            return self._within(lambda txn: Result("EXPLAIN", text=self._explained(txn, s.statement)), True)
        if isinstance(s, ast.Select):
            return self._within(lambda txn: Result("SELECT", df=self.analyzer(txn).select(s)), True)
        kinds = {ast.Insert: self._insert, ast.Update: self._update, ast.Delete: self._delete, ast.CreateTable: self._create, ast.DropTable: self._drop}
        return self._within(lambda txn: kinds[type(s)](txn, s), False)

    def _store(self) -> Store:
        if self.engine.store is None:
            raise InvalidInput("the engine has no store: external tables are read-only")
        return self.engine.store

    def _within(self, work: Callable[[Transaction | None], Result], read_only: bool) -> Result:
        """work in the open transaction, which survives errors, or in one of its own."""
        if self.txn is not None:
            return work(self.txn)
        if read_only and self.engine.store is None:
            return work(None)
        txn = self._store().begin(read_only)
        try:
            out = work(txn)
        except BaseException:
            self._store().rollback(txn)
            raise
        self._store().commit(txn)
        return out

    # Reading.

    def analyzer(self, txn: Transaction | None) -> Analyzer:
        def source(name: str) -> Source:
            if txn is not None and (spec := self.engine.store.table(txn, name)):
                return Source(self.engine.store.scan(txn, spec), spec.primary_key)
            if name in self.engine.external:
                return Source(self.engine.external_table(name))
            raise InvalidInput(f"table {name} does not exist")

        return Analyzer(self.engine.spark, source)

    def _explained(self, txn: Transaction | None, s) -> str:
        if isinstance(s, ast.Select):
            return explain(self.analyzer(txn).select(s))
        if isinstance(s, (ast.Update, ast.Delete)):
            where = (("where", s.where),) if s.where is not None else ()
            source = ast.Select(((ast.Star(), None),), (ast.TableRef(s.table),), **dict(where))
            return f"{type(s).__name__}: {s.table}\n{explain(self.analyzer(txn).select(source))}"
        if isinstance(s, ast.Insert):
            return f"Insert: {s.table} ({len(s.rows)} rows)"
        return f"{type(s).__name__}: {s}"

    # Tables.

    def tables(self) -> list[str]:
        stored = self._with_reader(lambda txn: [t.name for t in self.engine.store.tables(txn)]) if self.engine.store else []
        return sorted({*stored, *self.engine.external})

    def table(self, name: str) -> TableSpec:
        return self._with_reader(lambda txn: self._spec(txn, name))

    def _with_reader(self, work):
        return work(self.txn if self.txn is not None else self._store().begin(True))

    def _spec(self, txn: Transaction, name: str) -> TableSpec:
        spec = self._store().table(txn, name)
        if spec is None:
            if name in self.engine.external:
                raise InvalidInput(f"table {name} is read-only")
            raise InvalidInput(f"table {name} does not exist")
        return spec

    def _constant(self, e: ast.Expr) -> tuple[object, str | None]:
        t = compile_(e, Scope())
        return (t.constant[0] if t.constant else self.engine.spark.range(1).select(t.col).first()[0]), t.type

    def _create(self, txn: Transaction, s: ast.CreateTable) -> Result:
        store = self._store()
        store._writable(txn)
        if store.table(txn, s.name) is not None or s.name in self.engine.external:
            raise InvalidInput(f"table {s.name} already exists")
        columns = [vars(c) | {"default": None if c.default is None else self._constant(c.default)} for c in s.columns]
        store.put_table(txn, s.name, schema.defined(s.name, columns, lambda n: store.table(txn, n)))
        return Result("CREATE TABLE", name=s.name)

    def _drop(self, txn: Transaction, s: ast.DropTable) -> Result:
        store = self._store()
        store._writable(txn)
        if store.table(txn, s.name) is None:
            if s.if_exists:
                return Result("DROP TABLE", name=s.name, existed=False)
            raise InvalidInput(f"table {s.name} does not exist")
        for t in store.tables(txn):
            for c in t.columns:
                if c.references == s.name and t.name != s.name:
                    raise InvalidInput(f"table {s.name} is referenced from {t.name}.{c.name}")
        store.put_table(txn, s.name, None)
        return Result("DROP TABLE", name=s.name, existed=True)

    # Writing.

    def _typed(self, value: object, kind: str | None, c: schema.ColumnSpec) -> object:
        if value is not None and kind != c.type:
            raise InvalidInput(f"invalid datatype {kind} for {c.type} column {c.name}")
        return value

    def _insert(self, txn: Transaction, s: ast.Insert) -> Result:
        spec = self._spec(txn, s.table)
        names = [c.name for c in spec.columns]
        targets = list(s.columns) if s.columns is not None else names
        for i, n in enumerate(targets):
            spec.column(n)
            if n in targets[:i]:
                raise InvalidInput(f"column {n} given multiple times")
        compiled = [[compile_(e, Scope()) for e in row] for row in s.rows]
        values = self._values([t for row in compiled for t in row])
        rows, at = [], 0
        for row in compiled:
            if len(row) > len(targets):
                raise InvalidInput(f"too many values for table {spec.name}")
            if s.columns is not None and len(row) != len(targets):
                raise InvalidInput("column and value counts do not match")
            given = dict(zip(targets, zip(values[at : at + len(row)], (t.type for t in row), strict=True), strict=False))
            at += len(row)
            out = []
            for c in spec.columns:
                if c.name in given:
                    out.append(self._typed(*given[c.name], c))
                elif c.has_default:
                    out.append(c.default)
                else:
                    raise InvalidInput(f"no value given for column {c.name} with no default")
            rows.append(tuple(out))
        df = self.engine.spark.createDataFrame(rows, spec.struct())
        return Result("INSERT", count=dml.insert(self._store(), txn, spec, df))

    def _values(self, typed: list[scalar.Typed]) -> list:
        """Constants as they are; what must be computed, in one job."""
        rest = [(i, t) for i, t in enumerate(typed) if t.constant is None]
        out = [t.constant[0] if t.constant else None for t in typed]
        if rest:
            got = self.engine.spark.range(1).select(*(t.col.alias(f"v{i}") for i, t in rest)).first()
            for (i, _), v in zip(rest, got, strict=True):
                out[i] = v
        return out

    def insert_dataframe(self, table: str, df: DataFrame) -> Result:
        """Insert the rows of a DataFrame by column name, with all checks, without passing the driver."""

        def work(txn: Transaction) -> Result:
            spec = self._spec(txn, table)
            inner, fields = standardized(df)
            given = {f.name: f for f in fields}
            for f in fields:
                if (c := spec.column(f.name)).type != f.type:
                    raise InvalidInput(f"invalid datatype {f.type} for {c.type} column {c.name}")
            columns = []
            for c in spec.columns:
                if c.name not in given and not c.has_default:
                    raise InvalidInput(f"no value given for column {c.name} with no default")
                col = F.col(given[c.name].internal) if c.name in given else F.lit(c.default).cast(scalar.SPARK_TYPES[c.type])
                columns.append(col.alias(c.name))
            return Result("INSERT", count=dml.insert(self._store(), txn, spec, inner.select(*columns)))

        return self._within(work, False)

    def merge_changes(self, table: str, changes: DataFrame, column: str) -> Result:
        """Add changes (key column named as the table's, and "change") to a column of the rows they name, with all checks."""

        def work(txn: Transaction) -> Result:
            spec = self._spec(txn, table)
            spec.column(column)
            c = changes.select(F.col(spec.primary_key).alias("change_key"), F.col("change").alias("change_by"))
            rows = self._store().scan(txn, spec)
            j = rows.join(c, rows[spec.primary_key] == c["change_key"])
            new = [(rows[x.name] + c["change_by"]).alias(x.name) if x.name == column else rows[x.name] for x in spec.columns]
            return Result("UPDATE", count=dml.update(self._store(), txn, spec, j.select(c["change_key"].alias(dml.old_key(spec)), *new), False))

        return self._within(work, False)

    def _row_scope(self, spec: TableSpec, rows: DataFrame) -> tuple[DataFrame, Scope]:
        df, fields = standardized(rows)
        for f in fields:
            f.table = spec.name
        return df, Scope(fields, {spec.name})

    def _delete(self, txn: Transaction, s: ast.Delete) -> Result:
        spec = self._spec(txn, s.table)

        def condition(rows: DataFrame) -> DataFrame:
            df, scope = self._row_scope(spec, rows)
            df = df if s.where is None else df.where(predicate(s.where, scope))
            return df.select(*(F.col(f.internal).alias(f.name) for f in scope.fields))

        return Result("DELETE", count=dml.delete(self._store(), txn, spec, condition))

    def _update(self, txn: Transaction, s: ast.Update) -> Result:
        spec = self._spec(txn, s.table)
        df, scope = self._row_scope(spec, self._store().scan(txn, spec))
        df = df if s.where is None else df.where(predicate(s.where, scope))
        new: dict[str, object] = {}
        for name, e in s.changes:
            c = spec.column(name)
            if e is None:
                if not c.has_default:
                    raise InvalidInput(f"column {name} has no default value")
                new[name] = F.lit(c.default).cast(scalar.SPARK_TYPES[c.type])
                continue
            t = compile_(e, scope)
            if t.type not in (c.type, None):
                raise InvalidInput(f"invalid datatype {t.type} for {c.type} column {name}")
            new[name] = scalar.as_type(t, c.type)
        old = {f.name: F.col(f.internal) for f in scope.fields}
        columns = [new.get(c.name, old[c.name]).alias(c.name) for c in spec.columns]
        changed = df.select(old[spec.primary_key].alias(dml.old_key(spec)), *columns)
        return Result("UPDATE", count=dml.update(self._store(), txn, spec, changed, spec.primary_key in new))


def explain(df: DataFrame) -> str:
    """Catalyst's formatted plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
