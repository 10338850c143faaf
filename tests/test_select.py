"""SELECT: names, joins, grouping, order and limits, over small tables with NULL, NaN and repeated values."""

import bisect
import math

import pytest
from pyspark.sql import functions as F

from quartzite.errors import InvalidInput
from quartzite.plans import analyzer
from quartzite.session import Engine, explain

NAN = float("nan")


@pytest.fixture(scope="module")
def db(spark):
    engine = Engine(spark)
    tables = {
        "movies": (
            "id long, title string, studio_id long, genre_id long, released long, rating double, ultrahd boolean",
            [
                (1, "Stalker", 1, 1, 1979, 8.2, None), (2, "Sicario", 2, 2, 2015, 7.6, True), (3, "Primer", 3, 1, 2004, 6.9, None), (4, "Heat", 4, 2, 1995, 8.2, True),
                (5, "The Fountain", 4, 1, 2006, 7.2, False), (6, "Solaris", 1, 1, 1972, 8.1, None), (7, "Gravity", 4, 1, 2013, 7.7, True), (8, "Blindspotting", 2, 3, 2018, 7.4, True),
                (9, "Birdman", 4, 3, 2014, 7.7, True), (10, "Inception", 4, 1, 2010, 8.8, True),
            ],
        ),
        "genres": ("id long, name string", [(1, "Science Fiction"), (2, "Action"), (3, "Comedy")]),
        "studios": ("id long, name string, country_id string", [(1, "Mosfilm", "ru"), (2, "Lionsgate", "us"), (3, "StudioCanal", "fr"), (4, "Warner Bros", "us")]),
        "countries": ("id string, name string", [("fr", "France"), ("ru", "Russia"), ("us", "United States of America")]),
        "g": (
            "id long, grp string, flag boolean, num long, real double, word string",
            [
                (0, None, None, None, None, None), (1, "a", True, -1, 3.14, ""), (2, "b", False, 0, NAN, "abc"), (3, "a", True, 3, -0.0, "AB"),
                (4, "b", True, 42, math.inf, "👋"), (5, "a", False, 7, NAN, ""), (6, "b", False, -1, 0.0, "abc"),
            ],
        ),
        "empty": ("id long, x double", []),
    }
    for name, (types, rows) in tables.items():
        engine.register(name, spark.createDataFrame(rows, types))
    return engine.session()


def rows(db, sql):
    return db.execute(sql).rows()


def test_labels(db):
    r = db.execute("SELECT id, id AS id, id + 1, g.grp x, TRUE FROM g")
    assert r.columns == ["id", "id", "?", "x", "?"]
    assert db.execute("SELECT *, *, 1 FROM genres").columns == ["id", "name", "id", "name", "?"]


def test_names(db):
    for sql in (
        "SELECT nope FROM g", "SELECT x.id FROM g", "SELECT g.id FROM g AS x", "SELECT id FROM movies, genres", "SELECT * FROM g, g", "SELECT *", "SELECT id FROM nope",
        "SELECT id AS x FROM g WHERE x = 1", "SELECT 1 AS one, one + 1 FROM g", "SELECT m.id FROM genres x, movies m JOIN studios s ON s.id = x.id", "SELECT id FROM g WHERE id", "SELECT id FROM g WHERE COUNT(*) > 1",
    ):
        with pytest.raises(InvalidInput):
            db.execute(sql)


def test_joins(db):
    assert len(rows(db, "SELECT * FROM movies, genres")) == 30
    assert len(rows(db, "SELECT m.id FROM movies m JOIN genres g ON m.genre_id = g.id")) == 10
    left = rows(db, "SELECT m.id, g.name FROM movies m LEFT JOIN genres g ON m.id = g.id ORDER BY m.id")
    assert [x for _, x in left] == ["Science Fiction", "Action", "Comedy"] + [None] * 7
    right = rows(db, "SELECT g.name, m.id FROM genres g RIGHT JOIN movies m ON m.id = g.id")
    assert sorted(left) == sorted((i, n) for n, i in right)
    assert len(rows(db, "SELECT a.id FROM movies a JOIN movies b ON a.ultrahd = b.ultrahd AND a.id < b.id")) == 15  # NULL joins nothing
    assert rows(db, "SELECT a.id FROM g a JOIN g b ON a.real = b.real AND a.id < b.id") == [(3,)]  # nor does NaN; -0.0 is 0.0
    chain = rows(db, "SELECT m.title, c.name FROM movies m JOIN studios s ON m.studio_id = s.id JOIN countries c ON s.country_id = c.id WHERE c.id = 'fr'")
    assert chain == [("Primer", "France")]


def test_outer_joins_follow_the_standard(db):
    assert len(rows(db, "SELECT m.id FROM movies m LEFT JOIN genres g ON m.id = g.id WHERE g.id IS NULL")) == 7
    assert len(rows(db, "SELECT m.id FROM movies m LEFT JOIN genres g ON m.id = g.id AND m.id > 100")) == 10
    assert len(rows(db, "SELECT m.id FROM movies m LEFT JOIN empty e ON m.id = e.id")) == 10
    assert len(rows(db, "SELECT m.id FROM movies m LEFT JOIN genres g ON FALSE")) == 10


def test_joins_without_keys_share_out_their_pairs(spark):
    engine = Engine(spark)
    engine.register("t", spark.range(12_000).coalesce(1).selectExpr("id", "id * 7919 % 12000 AS v"))
    got = engine.session().sql("SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.v < b.v AND a.id > b.id")
    tasks = [n for _, n in got.groupBy(F.spark_partition_id()).count().collect()]
    seen, pairs = [], 0
    for v in (i * 7919 % 12_000 for i in range(12_000)):
        pairs += len(seen) - bisect.bisect(seen, v)
        bisect.insort(seen, v)
    assert sum(tasks) == pairs and max(tasks) < pairs / 3
    assert got.selectExpr("count(DISTINCT x * 12000 + y)").first()[0] == pairs


WITHOUT_KEYS = (
    "SELECT a.id, b.id FROM g a JOIN g b ON a.real < b.real", "SELECT a.id, b.id FROM g a JOIN g b ON a.word > b.word OR a.flag", "SELECT m.id, g.id FROM movies m, g",
    "SELECT m.id, g.id FROM movies m CROSS JOIN g WHERE m.id > 3 AND g.num < m.id AND g.id % 2 = 0", "SELECT a.id, b.id FROM movies a LEFT JOIN movies b ON a.released < b.released AND a.id > 4",
    "SELECT a.id, b.id FROM movies a RIGHT JOIN g b ON a.rating < b.real WHERE b.id <> 3", "SELECT a.id, b.id, c.name FROM g a JOIN movies b ON a.num < b.id JOIN genres c ON b.genre_id = c.id",
    "SELECT a.id, b.id FROM g a, movies b, genres c WHERE a.id = c.id AND b.genre_id = c.id", "SELECT a.id, b.id, c.id FROM g a JOIN g b ON a.id < b.id JOIN movies c ON b.id > c.id AND a.num <> 3",
    "SELECT a.grp, COUNT(*), MAX(b.id) FROM g a JOIN movies b ON a.id <= b.id GROUP BY a.grp", "SELECT a.id, b.id FROM g a JOIN empty b ON a.id > b.id", "SELECT 1 FROM g a JOIN movies b ON TRUE",
    "SELECT a.id, b.id FROM g a LEFT JOIN genres c ON a.id = c.id JOIN movies b ON c.id < b.id", "SELECT a.id, b.id FROM g a JOIN g b ON a.id < b.id LEFT JOIN genres c ON c.id = a.id WHERE c.id IS NULL",
)


def test_joins_without_keys_have_the_same_rows_in_blocks(db, spark, monkeypatch):
    whole = [sorted(rows(db, sql), key=str) for sql in WITHOUT_KEYS]
    assert len(whole[2]) == 70 and whole[0] and all(a is not None for a, _ in whole[0])
    monkeypatch.setattr(analyzer, "PAIRS", 12)
    monkeypatch.setattr(analyzer, "FEWEST", 2)
    dealt = [db.sql(sql) for sql in WITHOUT_KEYS]
    assert [sorted(map(tuple, df.collect()), key=str) for df in dealt] == whole
    assert dealt[0].rdd.getNumPartitions() == 9 and dealt[2].rdd.getNumPartitions() == 12
    ones = Engine(spark)
    ones.register("t", spark.range(60).selectExpr("1L AS id"))
    # Copies of one row are dealt out like others.
    got = ones.session().sql("SELECT a.id AS x FROM t a JOIN t b ON a.id <= b.id").groupBy(F.spark_partition_id()).count().collect()
    assert sum(n for _, n in got) == 3600 and max(n for _, n in got) <= 16


def test_blocks_have_bounded_pairs():
    for left in (1, 300, 8192, 8193, 60_000, 360_000, 10**9):
        for right in (1, 256, 5000, 8192, 100_000, 360_000):
            n, m = analyzer.blocks(left, right)
            most = max(analyzer.PAIRS, left * right / analyzer.TASKS)
            assert math.ceil(left / n) * math.ceil(right / m) <= 1.01 * most + left / n + right / m
            assert n * m <= 4 * (left * right / most + 1)


def test_aggregates(db):
    assert rows(db, "SELECT COUNT(*), COUNT(num), COUNT(real), SUM(num), AVG(num), MIN(num), MAX(num) FROM g") == [(7, 6, 6, 50, 8, -1, 42)]
    assert rows(db, "SELECT MIN(flag), MAX(flag), MIN(word), MAX(word) FROM g") == [(False, True, "", "👋")]
    assert math.isnan(rows(db, "SELECT MAX(real) FROM g")[0][0]) and math.isnan(rows(db, "SELECT SUM(real) FROM g")[0][0])
    assert rows(db, "SELECT COUNT(*), COUNT(x), SUM(id), AVG(x), MIN(x) FROM empty") == [(0, 0, None, None, None)]
    assert rows(db, "SELECT COUNT(NULL), SUM(NULL), AVG(NULL), MIN(NULL), COUNT(1), SUM(1) FROM g") == [(0, None, None, None, 7, 7)]
    assert rows(db, "SELECT SUM(1), COUNT(*)") == [(1, 1)] and rows(db, "SELECT COUNT(*) WHERE FALSE") == [(0,)]
    assert rows(db, "SELECT SUM(num * 10) / COUNT(num) + 7, SUM(num), SUM(num) FROM g") == [(90, 50, 50)]
    for sql in ("SELECT SUM(flag) FROM g", "SELECT AVG(word) FROM g", "SELECT SUM(MAX(num)) FROM g", "SELECT id, COUNT(*) FROM g", "SELECT SUM(num, id) FROM g"):
        with pytest.raises(InvalidInput):
            db.execute(sql)


def test_group_by(db):
    assert rows(db, "SELECT x FROM empty GROUP BY x") == []
    assert sorted(rows(db, "SELECT grp, COUNT(*) FROM g GROUP BY grp"), key=str) == [("a", 3), ("b", 3), (None, 1)]
    assert sorted(n for _, n in rows(db, "SELECT real, COUNT(*) FROM g GROUP BY real")) == [1, 1, 1, 2, 2]  # NaN and zeros are one group each
    assert sorted(rows(db, "SELECT id % 2 FROM g GROUP BY id % 2")) == [(0,), (1,)]
    assert rows(db, "SELECT COUNT(*) FROM g GROUP BY 1") == [(7,)] and rows(db, "SELECT 9, SUM(id) FROM g GROUP BY TRUE") == [(9, 21)]
    assert rows(db, "SELECT g.grp FROM g GROUP BY grp ORDER BY MAX(id) LIMIT 1") == [(None,)]
    for sql in ("SELECT grp AS x FROM g GROUP BY x", "SELECT id FROM g GROUP BY grp", "SELECT * FROM g GROUP BY id", "SELECT 1 FROM g GROUP BY COUNT(*)", "SELECT id + 1 FROM g GROUP BY 1 + id"):
        with pytest.raises(InvalidInput):
            db.execute(sql)


def test_having(db):
    assert rows(db, "SELECT grp FROM g GROUP BY grp HAVING MAX(num) > 10") == [("b",)]
    assert rows(db, "SELECT grp, MAX(num) AS m FROM g GROUP BY grp HAVING m < 10") == [("a", 7)]
    assert rows(db, "SELECT COUNT(*) FROM g HAVING COUNT(*) > 7") == []
    assert sorted(rows(db, "SELECT id FROM g GROUP BY id HAVING g.id > 4")) == [(5,), (6,)]
    with pytest.raises(InvalidInput):
        db.execute("SELECT * FROM g HAVING id > 3")


def test_order(db):
    assert [i for (i,) in rows(db, "SELECT id FROM g ORDER BY num, id")] == [0, 1, 6, 2, 3, 5, 4]
    up = [i for (i,) in rows(db, "SELECT id FROM g ORDER BY real, id")]
    assert up[0] == 0 and up[-2:] == [2, 5]  # NULL first, NaN last
    assert [i for (i,) in rows(db, "SELECT id FROM g ORDER BY real DESC, id DESC")][-1] == 0
    assert [t for (t,) in rows(db, "SELECT title FROM movies ORDER BY rating DESC, released LIMIT 3")] == ["Inception", "Stalker", "Heat"]
    assert [x for (x,) in rows(db, "SELECT -id AS id FROM genres ORDER BY id")] == [-3, -2, -1]
    assert [x for (x,) in rows(db, "SELECT -id AS id FROM genres ORDER BY genres.id")] == [-1, -2, -3]
    assert [i for (i,) in rows(db, "SELECT id FROM genres ORDER BY 1, id DESC")] == [3, 2, 1]  # 1 is a constant, not a place
    assert [i for (i,) in rows(db, "SELECT grp FROM g GROUP BY grp ORDER BY COUNT(*) DESC, grp DESC")] == ["b", "a", None]
    with pytest.raises(InvalidInput):
        db.execute("SELECT id AS x, name AS x FROM genres ORDER BY x")


def test_limit_and_offset(db):
    assert rows(db, "SELECT id FROM movies ORDER BY id LIMIT 2 OFFSET 1 + 2") == [(4,), (5,)]
    assert rows(db, "SELECT id FROM movies ORDER BY id OFFSET 8") == [(9,), (10,)]
    assert rows(db, "SELECT id FROM movies LIMIT 0") == []
    assert len(rows(db, "SELECT id FROM movies LIMIT 9223372036854775807")) == 10
    for sql in ("LIMIT -1", "LIMIT 1.5", "LIMIT id", "LIMIT NULL", "OFFSET -1", "OFFSET 'a'", "OFFSET 1 LIMIT 1"):
        with pytest.raises(InvalidInput):
            db.execute(f"SELECT id FROM movies {sql}")


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS double) AS x", "'s' AS s").write.parquet(path)
    engine = Engine(spark)
    engine.register("t", spark.read.parquet(path))
    text = explain(engine.session().sql("SELECT k, COUNT(*) FROM t WHERE id = 3 AND x > 2 GROUP BY k"))
    assert "EqualTo(id,3)" in text and "GreaterThan(x,2.0)" in text and "ReadSchema: struct<id:bigint,k:bigint,x:double>" in text
    join = explain(engine.session().sql("SELECT a.id FROM t a JOIN t b ON a.x = b.x"))
    assert "NestedLoop" not in join and "Cartesian" not in join


def test_limits_beyond_32_bits(spark):
    engine = Engine(spark)
    engine.register("t", spark.range(5).withColumnRenamed("id", "n"))
    s = engine.session()
    assert sorted(s.execute("SELECT n FROM t LIMIT 3000000000").rows()) == [(i,) for i in range(5)]
    assert s.execute("SELECT n FROM t ORDER BY n OFFSET 2147483648").rows() == []
    assert s.execute("SELECT n FROM t ORDER BY n LIMIT 9000000000 OFFSET 3").rows() == [(3,), (4,)]
