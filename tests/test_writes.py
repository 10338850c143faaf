"""DDL, DML, constraints and transactions on the versioned store."""

import math

import pytest

from quartzite.errors import InvalidInput, ReadOnly, Serialization
from quartzite.session import Engine


@pytest.fixture
def db(spark, tmp_path):
    with Engine(spark, str(tmp_path / "store")).session() as session:
        yield session


def rows(session, sql):
    return sorted(session.execute(sql).rows(), key=str)


def fails(session, sql, error=InvalidInput):
    with pytest.raises(error):
        session.execute(sql)


def test_create_and_show(db):
    db.execute('CREATE TABLE "T x" (id INT PRIMARY KEY, a VARCHAR NOT NULL DEFAULT \'x\', b DOUBLE UNIQUE, c BOOL INDEX, d TEXT DEFAULT NULL)')
    text = db.table("T x").show_create()
    assert text.startswith('CREATE TABLE "T x" (') and "a STRING NOT NULL DEFAULT 'x'" in text and "b FLOAT DEFAULT NULL UNIQUE INDEX" in text and "c BOOLEAN DEFAULT NULL INDEX" in text and "d STRING DEFAULT NULL\n" in text
    for bad in (
        "(a INT)", "(a INT PRIMARY KEY, b INT PRIMARY KEY)", "(a INT PRIMARY KEY NULL)", "(a INT PRIMARY KEY, b INT NOT NULL DEFAULT NULL)", "(a INT PRIMARY KEY, b INT DEFAULT 1.5)",
        "(a INT PRIMARY KEY, a INT)", "(a INT PRIMARY KEY, b INT REFERENCES nope)", "(a INT PRIMARY KEY, b STRING REFERENCES bad)", "(a INT PRIMARY KEY, b INT DEFAULT a)", "()",
    ):
        fails(db, f"CREATE TABLE bad {bad}")
    fails(db, 'CREATE TABLE "T x" (id INT PRIMARY KEY)')
    assert db.tables() == ["T x"]
    assert db.execute("DROP TABLE IF EXISTS nope").existed is False
    fails(db, "DROP TABLE nope")
    db.execute('DROP TABLE "T x"')
    assert db.tables() == []
    db.execute('CREATE TABLE "T x" (id STRING PRIMARY KEY)')
    assert rows(db, 'SELECT * FROM "T x"') == []


def test_insert(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, b BOOLEAN NOT NULL, f FLOAT DEFAULT 3.14, s STRING)")
    assert db.execute("INSERT INTO t VALUES (1, TRUE), (2, FALSE, -0.0), (1 + 2, 1 > 0, NULL, 'x' )").count == 3
    db.execute("INSERT INTO t (s, b, id) VALUES ('m', TRUE, 4)")
    got = rows(db, "SELECT * FROM t")
    assert got == [(1, True, 3.14, None), (2, False, 0.0, None), (3, True, None, "x"), (4, True, 3.14, "m")] and math.copysign(1, got[1][2]) == 1
    for bad in ("(5)", "(5, NULL)", "(5, TRUE, 1)", "(5, 1)", "(NULL, TRUE)", "(1, TRUE)", "(5, TRUE), (5, TRUE)", "('5', TRUE)", "(5.0, TRUE)", "(5, TRUE, 1.0, 'a', 2)"):
        fails(db, f"INSERT INTO t VALUES {bad}")
    for bad in ("(id, id) VALUES (5, 5)", "(nope) VALUES (5)", "(id, b) VALUES (5)", "(b) VALUES (TRUE)"):
        fails(db, f"INSERT INTO t {bad}")
    assert len(rows(db, "SELECT * FROM t")) == 4
    db.execute("CREATE TABLE f (x FLOAT PRIMARY KEY)")
    db.execute("INSERT INTO f VALUES (-0.0), (INFINITY)")
    for bad in ("NAN", "0.0", "1"):
        fails(db, f"INSERT INTO f VALUES ({bad})")


def test_update(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT, q INT NOT NULL DEFAULT 5)")
    db.execute("INSERT INTO t VALUES (0, NULL, 0), (1, 1, 0), (2, 2, 0)")
    assert db.execute("UPDATE t SET v = v + 10, q = v + 1 WHERE v IS NOT NULL").count == 2
    assert rows(db, "SELECT * FROM t") == [(0, None, 0), (1, 11, 2), (2, 12, 3)]
    db.execute("UPDATE t SET q = DEFAULT, v = NULL WHERE id = 2")
    assert rows(db, "SELECT * FROM t WHERE id = 2") == [(2, None, 5)]
    for bad in ("q = NULL", "q = 1.5", "id = NULL", "nope = 1", "id = id + 1", "id = 7", "id = DEFAULT", "q = 1, q = 2"):
        fails(db, f"UPDATE t SET {bad}")
    assert db.execute("UPDATE t SET id = id - 1").count == 3
    assert rows(db, "SELECT id FROM t") == [(-1,), (0,), (1,)]
    db.execute("UPDATE t SET id = id * 100 WHERE id != 0")
    assert rows(db, "SELECT id FROM t") == [(-100,), (0,), (100,)]
    assert db.execute("UPDATE t SET q = 1 WHERE FALSE").count == 0


def test_delete_and_insert_again(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, NULL)")
    assert db.execute("DELETE FROM t WHERE v = 'a' OR v IS NULL").count == 2
    db.execute("INSERT INTO t VALUES (1, 'again')")
    assert rows(db, "SELECT * FROM t") == [(1, "again"), (2, "b")]
    fails(db, "DELETE FROM t WHERE id")
    assert db.execute("DELETE FROM t").count == 2 and rows(db, "SELECT * FROM t") == []


def test_references(db):
    db.execute("CREATE TABLE p (id INT PRIMARY KEY)")
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p, self INT REFERENCES c)")
    db.execute("INSERT INTO p VALUES (1), (2)")
    db.execute("INSERT INTO c VALUES (1, 1, 1), (2, NULL, 1), (3, 1, 2)")
    for bad in ("INSERT INTO c VALUES (4, 9)", "INSERT INTO c VALUES (4, 1, 9)", "UPDATE c SET p = 9", "DELETE FROM p WHERE id = 1", "DELETE FROM c WHERE id = 1", "DROP TABLE p", "UPDATE p SET id = 9 WHERE id = 1"):
        fails(db, bad)
    db.execute("DELETE FROM p WHERE id = 2")
    assert db.execute("DELETE FROM c").count == 3
    db.execute("DROP TABLE c")
    db.execute("DROP TABLE p")


def test_unique(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, u STRING UNIQUE, f FLOAT UNIQUE)")
    db.execute("INSERT INTO t VALUES (1, 'a', NAN), (2, NULL, NAN), (3, NULL, 1.0)")
    for bad in ("INSERT INTO t VALUES (4, 'a')", "INSERT INTO t VALUES (4, 'x'), (5, 'x')", "UPDATE t SET u = 'a'", "UPDATE t SET f = 1.0 WHERE id = 1"):
        fails(db, bad)
    db.execute("UPDATE t SET u = 'a' WHERE id = 1")
    assert len(rows(db, "SELECT * FROM t")) == 3


def test_insert_dataframe(db, spark):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING DEFAULT 'd')")
    assert db.insert_dataframe("t", spark.range(100).selectExpr("cast(id AS int) AS id")).count == 100
    assert db.execute("SELECT COUNT(*), MIN(v) FROM t").one() == (100, "d")
    with pytest.raises(InvalidInput):
        db.insert_dataframe("t", spark.range(50, 150))


def test_explicit_transactions(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    fails(db, "COMMIT")
    fails(db, "ROLLBACK")
    db.execute("BEGIN")
    fails(db, "BEGIN")
    db.execute("INSERT INTO t VALUES (1, 'a')")
    fails(db, "INSERT INTO t VALUES (1, 'b')")  # the transaction goes on
    assert rows(db, "SELECT * FROM t") == [(1, "a")]
    db.execute("CREATE TABLE other (id INT PRIMARY KEY)")
    db.execute("ROLLBACK")
    assert rows(db, "SELECT * FROM t") == [] and db.tables() == ["t"]
    db.execute("BEGIN READ ONLY")
    fails(db, "INSERT INTO t VALUES (1, 'a')", ReadOnly)
    fails(db, "CREATE TABLE x (id INT PRIMARY KEY)", ReadOnly)
    db.execute("COMMIT")
    fails(db, "BEGIN AS OF SYSTEM TIME 1")
    fails(db, "BEGIN READ ONLY AS OF SYSTEM TIME 99")


def test_time_travel(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a')")
    one, two = db.engine.session(), db.engine.session()
    one.execute("BEGIN")
    one.execute("INSERT INTO t VALUES (2, 'b')")
    version = two.execute("BEGIN").transaction.version
    two.execute("UPDATE t SET v = 'x' WHERE id = 1")
    one.execute("COMMIT")
    two.execute("COMMIT")
    assert rows(db, "SELECT * FROM t") == [(1, "x"), (2, "b")]
    db.execute(f"BEGIN READ ONLY AS OF SYSTEM TIME {version}")
    assert rows(db, "SELECT * FROM t") == [(1, "a")]  # the first was still active then
    db.execute("COMMIT")
    store = db.engine.store
    assert store.compact(db.table("t")) == 2 and rows(db, "SELECT * FROM t") == [(1, "x"), (2, "b")]
    db.execute(f"BEGIN READ ONLY AS OF SYSTEM TIME {version}")
    assert rows(db, "SELECT * FROM t") == [(1, "a")]


@pytest.fixture
def pair(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    two = db.engine.session()
    db.execute("BEGIN")
    two.execute("BEGIN")
    return db, two


def test_dirty_fuzzy_and_phantom_reads_are_prevented(pair):
    one, two = pair
    one.execute("UPDATE t SET v = 'x' WHERE id = 1")
    one.execute("INSERT INTO t VALUES (3, 'c')")
    assert rows(two, "SELECT * FROM t") == [(1, "a"), (2, "b")]
    one.execute("COMMIT")
    assert rows(two, "SELECT * FROM t") == [(1, "a"), (2, "b")]
    two.execute("COMMIT")
    assert rows(two, "SELECT * FROM t") == [(1, "x"), (2, "b"), (3, "c")]


def test_conflicting_writes_fail(pair):
    one, two = pair
    one.execute("UPDATE t SET v = 'x' WHERE id = 1")
    fails(two, "UPDATE t SET v = 'y' WHERE id = 1", Serialization)
    fails(two, "DELETE FROM t", Serialization)
    one.execute("COMMIT")
    fails(two, "UPDATE t SET v = 'y' WHERE id = 1", Serialization)  # a lost update
    two.execute("ROLLBACK")
    two.execute("UPDATE t SET v = 'y' WHERE id = 1")
    assert rows(one, "SELECT * FROM t") == [(1, "y"), (2, "b")]


def test_write_skew_is_allowed(pair):
    one, two = pair
    one.execute("UPDATE t SET v = 'b' WHERE id = 1")
    two.execute("UPDATE t SET v = 'a' WHERE id = 2")
    one.execute("COMMIT")
    two.execute("COMMIT")
    assert rows(one, "SELECT * FROM t") == [(1, "b"), (2, "a")]


def test_closing_rolls_back_and_retry_works(pair):
    one, two = pair
    two.execute("UPDATE t SET v = 'z' WHERE id = 2")
    two.close()
    one.execute("COMMIT")
    assert rows(one, "SELECT * FROM t") == [(1, "a"), (2, "b")]
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise Serialization()
        return "done"

    assert one.engine.with_retry(work, least_s=0.001) == "done" and len(tries) == 3


def test_resume(pair):
    one, two = pair
    two.execute("DELETE FROM t WHERE id = 2")
    store = two.engine.store
    again = store.resume(two.txn.version)
    assert again.version == two.txn.version and again.statements == two.txn.statements and again.active == two.txn.active
    store.commit(again)
    two.txn = None
    assert rows(two, "SELECT * FROM t") == [(1, "a")]
    assert store.status()["active"] == [one.txn.version]


def test_explain(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    assert "Physical Plan" in db.execute("EXPLAIN SELECT * FROM t WHERE id = 1").text
    assert "Delete: t" in db.execute("EXPLAIN DELETE FROM t WHERE id = 1").text
    fails(db, "EXPLAIN EXPLAIN SELECT 1")
    assert rows(db, "SELECT * FROM t") == []


def test_schema_text_is_sql(db):
    db.execute('CREATE TABLE "select" (id INT PRIMARY KEY, "index" INT UNIQUE, ref INT REFERENCES "select")')
    text = db.table("select").show_create()
    assert text == 'CREATE TABLE "select" (\n  id INTEGER PRIMARY KEY,\n  "index" INTEGER DEFAULT NULL UNIQUE INDEX,\n  ref INTEGER DEFAULT NULL INDEX REFERENCES "select"\n)'
    db.execute('DROP TABLE "select"')
    db.execute(text)
    assert db.table("select").show_create() == text


@pytest.mark.parametrize("early", [True, False])
def test_compaction_loses_no_concurrent_write(db, monkeypatch, early):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.execute("UPDATE t SET v = 'c' WHERE id = 1")
    store, other = db.engine.store, db.engine.session()
    write = store.write

    def slow_write(*given, **named):
        n = write(*given, **named)
        monkeypatch.setattr(store, "write", write)
        other.execute("BEGIN")
        if early:
            other.execute("INSERT INTO t VALUES (3, 'new')")
        return n

    monkeypatch.setattr(store, "write", slow_write)
    if early:
        with pytest.raises(Serialization):
            # The other transaction finds the new definition; had it not looked, the compaction would find its rows.
            store.compact(db.table("t"))
    else:
        store.compact(db.table("t"))
        fails(other, "INSERT INTO t VALUES (3, 'new')", Serialization)
        other.execute("ROLLBACK")
        other.execute("BEGIN")
        other.execute("INSERT INTO t VALUES (3, 'new')")
        other.execute("COMMIT")
        assert rows(db, "SELECT * FROM t") == [(1, "c"), (2, "b"), (3, "new")]


def test_compaction_gives_up_when_rows_came(db, monkeypatch):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a')")
    db.execute("UPDATE t SET v = 'c'")
    store, other, spec = db.engine.store, db.engine.session(), db.table("t")
    put = store.put_table

    def late_put(*given):  # another transaction writes after the compaction began and before its definition is there
        other.execute("BEGIN")
        other.execute("INSERT INTO t VALUES (3, 'new')")
        monkeypatch.setattr(store, "put_table", put)
        put(*given)

    monkeypatch.setattr(store, "put_table", late_put)
    with pytest.raises(Serialization):
        store.compact(spec)
    other.execute("COMMIT")
    assert rows(db, "SELECT * FROM t") == [(1, "c"), (3, "new")]


def test_compaction_on_opening(db, spark):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.execute("UPDATE t SET v = 'c'")
    before = db.table("t").folder
    assert Engine(spark, db.engine.root, compact_at=0.9).store.garbage(db.table("t")) == 0.5 and db.table("t").folder == before
    Engine(spark, db.engine.root, compact_at=0.5)
    assert db.table("t").folder != before and db.engine.store.garbage(db.table("t")) == 0 and rows(db, "SELECT * FROM t") == [(1, "c"), (2, "c")]


def test_temporary_store_and_typed_values(spark):
    engine = Engine.temporary(spark)
    with engine.session() as s:
        s.execute("CREATE TABLE t (id INT PRIMARY KEY, f FLOAT, b BOOLEAN, s STRING)")
        s.execute("INSERT INTO t VALUES (1, 2.5, TRUE, 'x')")
        assert s.execute("SELECT id FROM t").integer() == 1 and s.execute("SELECT f FROM t").floating() == 2.5
        assert s.execute("SELECT b FROM t").boolean() is True and s.execute("SELECT s FROM t").string() == "x"
        for sql in ("SELECT b FROM t", "SELECT id, f FROM t", "SELECT id FROM t WHERE FALSE"):
            with pytest.raises(InvalidInput):
                s.execute(sql).integer()
    assert engine.status()["active"] == []
