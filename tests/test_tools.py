"""Workloads, the shell, and the registry against DuckDB."""

import os

import duckdb
import pytest

from quartzite import cli, queries, workloads
from quartzite.session import Engine

SF = "/root/testdata/sf0.001"


def test_workloads(spark, tmp_path):
    assert workloads.read(spark, str(tmp_path / "r"), rows=20, lookups=50).count() == 50
    assert workloads.write(spark, str(tmp_path / "w"), rows=100).first()[0] == 100
    after = workloads.bank(spark, str(tmp_path / "b"), customers=5, accounts=3, transfers=40).collect()
    assert len(after) == 5 and min(r.least for r in after) >= 0 and len({r.total for r in after}) > 1


def test_shell(spark, tmp_path):
    session = Engine(spark, str(tmp_path / "s")).session()
    state = {"headers": False}
    assert cli.described(session.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING, f FLOAT)"), False) == "CREATE TABLE"
    assert cli.described(session.execute("INSERT INTO t VALUES (1, 'it''s', NAN), (2, NULL, -INFINITY)"), False) == "INSERT 2 rows"
    assert cli.described(session.execute("SELECT * FROM t ORDER BY id"), True) == "id, v, f\n1, 'it''s', NaN\n2, NULL, -inf"
    assert cli.command(session, "!tables", state) == "t" and "PRIMARY KEY" in cli.command(session, "!table t", state)
    assert "versions: 2" in cli.command(session, "!status", state) and cli.command(session, "!headers", state) == "headers on"
    session.execute("DELETE FROM t WHERE id = 1")
    assert cli.command(session, "!dump t", state).count("\n") == 2


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["flagship", "left_where_null", "avg_int_truncating", "float_division_by_zero", "join_nan_keys", "group_by_null", "limit_offset", "update_pk", "as_of_read", "snapshot_read", "show_create", *queries.SCRIPTS])
def test_registry(spark, name):
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    got = sorted(([_norm(r[c]) for c in columns] for r in df.collect()), key=str)
    assert sorted(want.columns) == columns
    assert got == sorted(([_norm(r[want.columns.index(c)]) for c in columns] for r in want.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["commit_visible", "rollback_invisible", "snapshot_read", "read_own_writes"])
def test_sessions_read_the_whole_table(spark, name):
    test_registry(spark, name)
    gone = "c_custkey < 5" if name == "read_own_writes" else "FALSE"
    rows = duckdb.sql(f"SELECT count(*) FROM '{SF}/customer.parquet' WHERE NOT ({gone})").fetchall()[0][0]
    assert queries.queries()[name](spark, SF).count() == rows > 20
