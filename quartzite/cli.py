"""A small shell: python -m quartzite.cli [--root FOLDER] [--parquet FOLDER] [STATEMENT]"""

from __future__ import annotations

import argparse
import math
import os

from pyspark.sql import SparkSession

from .errors import Error
from .session import Engine, Result, Session

HELP = """Statements end with a line's end. Commands: !headers toggles headers, !help, !status, !table NAME, !tables, !dump NAME (stored rows with versions), !quit."""


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("inf" if value > 0 else "-inf")
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def described(r: Result, headers: bool) -> str:
    if r.kind == "SELECT":
        lines = [", ".join(shown(v) for v in row) for row in r.rows()]
        return "\n".join(([", ".join(r.columns)] if headers else []) + lines)
    if r.kind == "BEGIN":
        return f"began {'read-only ' if r.transaction.read_only else ''}transaction at version {r.transaction.version}"
    if r.text is not None:
        return r.text
    return r.kind if r.count is None else f"{r.kind} {r.count} rows"


def command(session: Session, line: str, state: dict) -> str:
    name, _, arg = line.partition(" ")
    if name == "!headers":
        state["headers"] = not state["headers"]
        return f"headers {'on' if state['headers'] else 'off'}"
    if name == "!tables":
        return "\n".join(session.tables())
    if name == "!table":
        return session.table(arg.strip()).show_create()
    if name == "!status":
        return "\n".join(f"{k}: {v}" for k, v in session.engine.store.status().items())
    if name == "!dump":
        spec = session.table(arg.strip())
        rows = session.engine.store.history(spec).orderBy("v", "s").collect()
        return "\n".join(f"v={r['v']} s={r['s']} {'deleted' if r['__deleted'] else 'row'} " + ", ".join(shown(x) for x in list(r)[: len(spec.columns)]) for r in rows)
    return HELP


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", help="folder of the versioned store")
    p.add_argument("--parquet", help="folder of NAME.parquet tables to register")
    p.add_argument("statement", nargs="?")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quartzite").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, a.root)
    if a.parquet:
        engine.register_parquet(a.parquet, sorted(x.removesuffix(".parquet") for x in os.listdir(a.parquet) if x.endswith(".parquet")))
    state = {"headers": False}
    with engine.session() as session:
        if a.statement:
            print(described(session.execute(a.statement), True))
            return 0
        while True:
            try:
                line = input("quartzite> " if session.txn is None else f"quartzite:{session.txn.version}> ").strip()
            except EOFError:
                return 0
            if line in ("!quit", "!exit"):
                return 0
            try:
                print(command(session, line, state) if line.startswith("!") else described(session.execute(line), state["headers"]) if line else "")
            except Error as e:
                print(f"Error: {e}")
            except Exception as e:  # Spark's own errors: their first line
                print(f"Error: {str(e).splitlines()[0]}")


if __name__ == "__main__":
    raise SystemExit(main())
