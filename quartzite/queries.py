"""The query registry: each operator of the dialect over the shared tables, with DuckDB's SQL for the same rows.

A statement in REGISTRY runs as it stands in the dialect. Its twin is written
out where DuckDB spells it differently (integer division, types of sums and of
32-bit columns, NaN); None means that the same text serves both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidInput, ReadOnly, Serialization
from .session import Engine, Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Where urgent orders are still open: by nation, how many, whose is the dearest, and how rich the customers are.
FLAGSHIP = """
SELECT r.r_name AS region, n.n_name AS nation, COUNT(*) AS urgent, MAX(o.o_totalprice) AS dearest, MIN(c.c_acctbal) AS poorest
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
     JOIN nation n ON n.n_nationkey = c.c_nationkey
     JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O' AND c.c_acctbal > 0
GROUP BY r.r_name, n.n_name
HAVING COUNT(*) > 1
ORDER BY urgent DESC, nation
"""

SAME = None
REGISTRY: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, SAME),
    # Scans and constant rows.
    "scan_all": ("SELECT * FROM supplier", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"),
    "scan_filter": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'", SAME),
    "pk_lookup": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42", SAME),
    "pk_lookup_multi": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 1 OR c_custkey = 7 OR c_custkey = 7 OR c_custkey = 99", SAME),
    "index_lookup": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'", SAME),
    "lookup_is_null": ("SELECT o.o_orderkey AS k FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NULL", SAME),
    "values_constant": ("SELECT 1 AS a, 2.5 AS b, 'x' AS c, TRUE AS d", "SELECT CAST(1 AS BIGINT) AS a, CAST(2.5 AS DOUBLE) AS b, 'x' AS c, TRUE AS d"),
    "select_where_false": ("SELECT c_custkey FROM customer WHERE FALSE", SAME),
    # Projection.
    "project_columns": ("SELECT p_partkey, p_brand FROM part", SAME),
    "project_exprs": ("SELECT l_orderkey, l_linenumber + 1 AS next, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) + 1 AS next, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "project_alias": ("SELECT r_name AS name, r_regionkey id FROM region", "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS id FROM region"),
    "project_star_mixed": ("SELECT *, r_regionkey * 10 AS tenfold FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(r_regionkey AS BIGINT) * 10 AS tenfold FROM region"),
    "table_alias": ("SELECT a.s_suppkey FROM supplier AS a WHERE a.s_acctbal < 0", SAME),
    "hidden_order_column": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", SAME),
    # Logic and comparison.
    "and_or_not": ("SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND p_size < 40) OR p_retailprice > 1500", SAME),
    "three_valued_logic": (
        "SELECT TRUE AND NULL AS a, FALSE AND NULL AS b, TRUE OR NULL AS c, FALSE OR NULL AS d, NOT NULL AS e",
        "SELECT TRUE AND NULL AS a, FALSE AND NULL AS b, TRUE OR NULL AS c, FALSE OR NULL AS d, NOT CAST(NULL AS BOOLEAN) AS e",
    ),
    "eq_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_orderpriority != '5-LOW'", SAME),
    "gt_ge_lt_le": ("SELECT l_orderkey, l_linenumber * 1 AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity >= 11 AND l_quantity < 40 AND l_quantity <= 39", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity >= 11 AND l_quantity < 40 AND l_quantity <= 39"),
    "compare_mixed_int_float": ("SELECT p_partkey FROM part WHERE p_size * 30 > p_retailprice AND p_size >= 20.5", SAME),
    "compare_strings": ("SELECT n_name FROM nation WHERE n_name > 'G' AND n_name <= 'NATION_9'", SAME),
    "compare_booleans": ("SELECT c_custkey FROM customer WHERE (c_acctbal > 0) > (c_custkey < 100)", SAME),
    "is_null": ("SELECT l.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL", SAME),
    "is_not_null": ("SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL", SAME),
    "is_nan": ("SELECT s_suppkey, s_acctbal IS NAN AS a, (s_acctbal * 0 / 0) IS NAN AS b, (NULL * s_acctbal) IS NAN AS c FROM supplier", "SELECT s_suppkey, isnan(s_acctbal) AS a, TRUE AS b, CAST(NULL AS BOOLEAN) AS c FROM supplier"),
    "nan_compare": (
        "SELECT NAN = NAN AS a, NAN > 1 AS b, NAN < 1 AS c, NAN != NAN AS d, NULL = NAN AS e, NAN >= NAN AS f",
        "SELECT FALSE AS a, FALSE AS b, FALSE AS c, TRUE AS d, CAST(NULL AS BOOLEAN) AS e, FALSE AS f",
    ),
    # Mathematics.
    "add_sub_mul": ("SELECT o_orderkey + 1 AS a, o_orderkey - o_custkey AS b, o_orderkey * 3 AS c FROM orders", SAME),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS a, (0 - o_orderkey) / 7 AS b FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, (0 - o_orderkey) // 7 AS b FROM orders"),
    "float_division": ("SELECT p_partkey, p_retailprice / 4 AS a FROM part", SAME),
    "float_division_by_zero": (
        "SELECT s_suppkey, s_acctbal / 0 AS a, 1 / -0.0 AS b FROM supplier WHERE s_acctbal != 0",
        "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END AS a, CAST('-inf' AS DOUBLE) AS b FROM supplier WHERE s_acctbal <> 0",
    ),
    "int_remainder": ("SELECT o_orderkey, o_orderkey % 7 AS a, (0 - o_orderkey) % 7 AS b FROM orders", SAME),
    "float_remainder": ("SELECT l_orderkey, l_quantity % 7.5 AS a FROM lineitem", SAME),
    "power_int": ("SELECT n_nationkey, n_nationkey ^ 3 AS a, 3 ^ 39 AS b, 2 ^ n_nationkey AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey AS BIGINT) * n_nationkey * n_nationkey AS a, 4052555153018976267 AS b, CAST(pow(2, n_nationkey) AS BIGINT) AS c FROM nation"),
    "power_float": ("SELECT p_partkey, p_retailprice ^ 2 AS a, 2 ^ -2 AS b FROM part", "SELECT p_partkey, pow(p_retailprice, 2) AS a, CAST(0.25 AS DOUBLE) AS b FROM part"),
    "factorial": ("SELECT n_nationkey, n_nationkey! AS a FROM nation WHERE n_nationkey <= 20", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(factorial(n_nationkey) AS BIGINT) AS a FROM nation WHERE n_nationkey <= 20"),
    "negate_identity": ("SELECT s_suppkey, -s_acctbal AS a, +s_suppkey AS b, --s_suppkey AS c FROM supplier", "SELECT s_suppkey, -s_acctbal AS a, s_suppkey AS b, s_suppkey AS c FROM supplier"),
    "sqrt_int_float": ("SELECT p_partkey, sqrt(p_size) AS a, sqrt(p_retailprice) AS b FROM part", SAME),
    "precedence": ("SELECT 1 + 2 * 3 ^ 2 AS a, -3 ^ 2 AS b, 2 ^ 3 ^ 2 AS c, 2 + 3! AS d, NOT 1 = 2 AND TRUE AS e, 7 - 2 - 1 AS f", "SELECT CAST(19 AS BIGINT) AS a, CAST(9 AS BIGINT) AS b, CAST(512 AS BIGINT) AS c, CAST(8 AS BIGINT) AS d, TRUE AS e, CAST(4 AS BIGINT) AS f"),
    # Strings.
    "like_prefix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'b%'", SAME),
    "like_suffix": ("SELECT p_partkey FROM part WHERE p_type LIKE '%L'", SAME),
    "like_contains": ("SELECT p_partkey FROM part WHERE p_brand LIKE '%3%'", SAME),
    "like_single_char": ("SELECT n_name FROM nation WHERE n_name LIKE '_A%_1_'", SAME),
    "not_like": ("SELECT c_custkey FROM customer WHERE NOT c_mktsegment LIKE '%U%'", SAME),
    # Joins.
    "cross_join": ("SELECT r.r_name AS r, n.n_name AS n FROM region r CROSS JOIN nation n", SAME),
    "comma_join": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2", SAME),
    "comma_join_where": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", SAME),
    "inner_equi": ("SELECT o.o_orderkey AS k, c.c_name AS c FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", SAME),
    "inner_theta": ("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a INNER JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey > b.s_suppkey", SAME),
    "inner_multi_key": ("SELECT c.c_custkey AS c, s.s_suppkey AS s FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey", SAME),
    "inner_residual": ("SELECT o.o_orderkey AS o FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20", SAME),
    "left_equi": ("SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", SAME),
    "left_theta": ("SELECT r.r_name AS r, n.n_name AS n FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey", SAME),
    "left_where_null": ("SELECT c.c_custkey AS c FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", SAME),
    "left_one_sided_on": ("SELECT c.c_custkey AS c, n.n_name AS n FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000", SAME),
    "right_equi": ("SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", SAME),
    "right_theta": ("SELECT n.n_name AS n, r.r_name AS r FROM nation n RIGHT OUTER JOIN region r ON n.n_nationkey < r.r_regionkey", SAME),
    "three_way": ("SELECT c.c_name AS c, n.n_name AS n, r.r_name AS r FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", SAME),
    "left_then_right": ("SELECT n.n_name AS n, s.s_name AS s, c.c_custkey AS c FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey RIGHT JOIN customer c ON c.c_custkey = s.s_suppkey", SAME),
    "self_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", SAME),
    "join_transitive_filter": ("SELECT o.o_orderkey AS o FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 5 OR c.c_custkey = 17", SAME),
    "join_nan_keys": ("SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a LEFT JOIN region b ON a.r_regionkey * 0.0 / 0 = b.r_regionkey * 0.0 / 0", "SELECT CAST(r_regionkey AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM region"),
    "join_mixed_types": ("SELECT a.n_name AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON a.n_nationkey * 1.0 = b.s_suppkey", SAME),
    # Aggregates.
    "agg_global": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders"),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_totalprice) AS a, MAX(o_orderstatus) AS m FROM orders WHERE FALSE", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MAX(o_orderstatus) AS m FROM orders WHERE FALSE"),
    "agg_group_empty": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", SAME),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", SAME),
    "count_col": ("SELECT COUNT(l.toxic) AS n, COUNT(*) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", SAME),
    "sum_int": ("SELECT o_orderpriority, SUM(o_custkey) AS s FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority"),
    "sum_float": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", SAME),
    "avg_int_truncating": ("SELECT o_orderstatus, AVG(o_custkey) AS a, AVG(0 - o_custkey) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) // COUNT(o_custkey) AS a, CAST(-SUM(o_custkey) AS BIGINT) // COUNT(o_custkey) AS b FROM orders GROUP BY o_orderstatus"),
    "avg_float": ("SELECT l_returnflag, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag", SAME),
    "min_max_types": ("SELECT MIN(c_acctbal > 0) AS a, MAX(c_acctbal > 0) AS b, MIN(c_name) AS c, MAX(c_custkey) AS d, MIN(c_acctbal) AS e FROM customer", SAME),
    "group_by_one": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", SAME),
    "group_by_many": ("SELECT l_returnflag, l_linestatus, l_linenumber * 1 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber * 1", "SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS k, COUNT(*) AS n FROM lineitem GROUP BY ALL"),
    "group_by_expr": ("SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", SAME),
    "group_by_constant": ("SELECT COUNT(*) AS n FROM orders GROUP BY 1", "SELECT COUNT(*) AS n FROM orders"),
    "group_by_null": ("SELECT l.toxic AS toxic, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic", "SELECT CAST(l.toxic AS BIGINT) AS toxic, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic"),
    "group_as_distinct": ("SELECT lang, source FROM documents GROUP BY lang, source", SAME),
    "agg_expr": ("SELECT o_orderstatus, SUM(o_custkey * 10) / COUNT(o_custkey) + 7 AS x FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_custkey * 10) AS BIGINT) // COUNT(o_custkey) + 7 AS x FROM orders GROUP BY o_orderstatus"),
    "agg_over_join": ("SELECT n.n_name AS n, COUNT(*) AS k, MAX(o.o_totalprice) AS m FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name", SAME),
    # HAVING.
    "having_agg": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", SAME),
    "having_unselected_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) - MIN(o_totalprice) > 250000", SAME),
    "having_alias": ("SELECT c_nationkey * 1 AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey * 1 HAVING n > 50", "SELECT CAST(c_nationkey AS BIGINT) AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50"),
    "having_group_expr": ("SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10 HAVING o_custkey % 10 > 4", "SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10 HAVING b > 4"),
    # Order, limit and offset.
    "order_asc_desc": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 25", SAME),
    "order_nulls": (
        "SELECT d.doc_id AS doc_id, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic, d.doc_id LIMIT 20",
        "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic NULLS FIRST, d.doc_id LIMIT 20",
    ),
    "order_expr": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey % 100 DESC, o_orderkey LIMIT 15", SAME),
    "order_by_alias": ("SELECT c_custkey AS k, c_acctbal * 2 AS twice FROM customer ORDER BY twice, k LIMIT 12", SAME),
    "order_by_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 9", SAME),
    "limit_ordered": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5 + 5", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10"),
    "offset_ordered": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 5", SAME),
    "limit_offset": ("SELECT p_partkey, p_size * 1 AS size FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 20", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 20"),
    "limit_zero": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 0", SAME),
    # The shapes of the analytic benchmark.
    "pricing_summary": (
        """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, MAX(l_extendedprice * (1 - l_discount)) AS top_net,
           AVG(l_quantity) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_tax < 0.07 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        SAME,
    ),
    "top_customers": (
        """SELECT c.c_custkey AS c, n.n_name AS n, COUNT(*) AS k, MAX(o.o_totalprice) AS m
           FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
           GROUP BY c.c_custkey, n.n_name ORDER BY k DESC, c LIMIT 20""",
        SAME,
    ),
}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, TABLES)


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir).session().sql(text)


# Statements that write: each works on a store of its own in the shared folder.


def store_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/quartzite-{uuid.uuid4().hex}"


ACCOUNTS = """CREATE TABLE accounts (id INTEGER PRIMARY KEY, name STRING NOT NULL, nation INTEGER, balance FLOAT DEFAULT 1.5, segment STRING DEFAULT 'none')"""


def _accounts(spark: SparkSession, sf_dir: str, load: bool = True) -> Session:
    engine = Engine(spark, store_folder(spark)).register_parquet(sf_dir, TABLES)
    session = engine.session()
    session.execute(ACCOUNTS)
    if load:
        rows = session.sql("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
        session.insert_dataframe("accounts", rows)
    return session


LOADED = "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer"


def _after(*statements: str, load: bool = True, then: str = "SELECT * FROM accounts") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _accounts(spark, sf_dir, load)
        for s in statements:
            session.execute(s)
        return session.sql(then)

    return run


def _two_sessions(first: list[str], second: list[str], third: list[str], read_first: bool, then: str = "SELECT id, balance FROM accounts") -> Callable[[SparkSession, str], DataFrame]:
    """Statements of one session, then of another, then of the first; what a session then reads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = _accounts(spark, sf_dir)
        two = one.engine.session()
        for session, statements in ((one, first), (two, second), (one, third)):
            for s in statements:
                session.execute(s)
        return (one if read_first else two).sql(then)

    return run


def as_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _accounts(spark, sf_dir)
    version = session.execute("BEGIN").transaction.version
    session.execute("DELETE FROM accounts WHERE id > 10")
    session.execute("COMMIT")
    session.execute("UPDATE accounts SET balance = 0.0")
    session.execute(f"BEGIN READ ONLY AS OF SYSTEM TIME {version}")
    return session.sql("SELECT * FROM accounts")


def _texts(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, outcome string")


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _engine(spark, sf_dir).session().execute("EXPLAIN SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 100").text
    return _texts(spark, [("plan", text)])


def _outcome(session: Session, statement: str) -> str:
    """What came of a statement: its kind and count, the rows of a SELECT in their order, or the error."""
    try:
        r = session.execute(statement)
    except (InvalidInput, ReadOnly, Serialization) as e:
        return f"{type(e).__name__}: {e}"
    if r.df is not None:
        return "; ".join(", ".join("NULL" if v is None else str(v) for v in row) for row in r.rows())
    return r.kind if r.count is None else f"{r.kind} {r.count}"


def _script(*steps: tuple[int, str, str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query that runs statements in sessions 1, 2, ... of one empty store and returns what came of each; and SQL for what must."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, store_folder(spark))
        sessions = {i: engine.session() for i in sorted({i for i, _, _ in steps})}
        rows = [(n, text, _outcome(sessions[i], text)) for n, (i, text, _) in enumerate(steps, 1)]
        return spark.createDataFrame(rows, "step long, statement string, outcome string")

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(f"({n}, {quoted(text)}, {quoted(outcome)})" for n, (_, text, outcome) in enumerate(steps, 1))
    return run, f"SELECT CAST(step AS BIGINT) AS step, statement, outcome FROM (VALUES {values}) AS v(step, statement, outcome)"


def show_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _accounts(spark, sf_dir, load=False)
    session.execute('CREATE TABLE note (id INTEGER PRIMARY KEY, account INTEGER REFERENCES accounts, "index" INTEGER INDEX, tag STRING UNIQUE, seen BOOLEAN NOT NULL DEFAULT FALSE)')
    return _texts(spark, [(n, session.table(n).show_create()) for n in ("accounts", "note")])


_SHOWN = """SELECT step, array_to_string(lines, chr(10)) AS outcome FROM (VALUES
('accounts', ['CREATE TABLE accounts (', '  id INTEGER PRIMARY KEY,', '  name STRING NOT NULL,', '  nation INTEGER DEFAULT NULL,',
  '  balance FLOAT DEFAULT 1.5,', '  segment STRING DEFAULT ''none''', ')']),
('note', ['CREATE TABLE note (', '  id INTEGER PRIMARY KEY,', '  account INTEGER DEFAULT NULL INDEX REFERENCES accounts,',
  '  "index" INTEGER DEFAULT NULL INDEX,', '  tag STRING DEFAULT NULL UNIQUE INDEX,', '  seen BOOLEAN NOT NULL DEFAULT FALSE', ')'])) AS v(step, lines)"""

#: Statements of several sessions on an empty store, with what must come of each.
SCRIPTS = {
    "constraint_errors": _script(
        (1, "CREATE TABLE accounts (id INTEGER PRIMARY KEY, name STRING NOT NULL, rate FLOAT DEFAULT 1.5)", "CREATE TABLE"),
        (1, "INSERT INTO accounts VALUES (1, 'a')", "INSERT 1"),
        (1, "INSERT INTO accounts VALUES (1, 'b')", "InvalidInput: primary key 1 already exists"),
        (1, "INSERT INTO accounts VALUES (2, NULL)", "InvalidInput: NULL value not allowed for column name"),
        (1, "INSERT INTO accounts VALUES (NULL, 'c')", "InvalidInput: invalid primary key None"),
        (1, "INSERT INTO accounts VALUES (3, 4)", "InvalidInput: invalid datatype INTEGER for STRING column name"),
        (1, "INSERT INTO accounts VALUES (3, 'd', 'e')", "InvalidInput: invalid datatype STRING for FLOAT column rate"),
        (1, "INSERT INTO accounts (id) VALUES (3)", "InvalidInput: no value given for column name with no default"),
        (1, "CREATE TABLE notes (id INTEGER PRIMARY KEY, account INTEGER REFERENCES accounts, tag STRING UNIQUE)", "CREATE TABLE"),
        (1, "INSERT INTO notes VALUES (1, 9, 'x')", "InvalidInput: reference 9 not in table accounts"),
        (1, "INSERT INTO notes VALUES (1, 1, 'x')", "INSERT 1"),
        (1, "INSERT INTO notes VALUES (2, 1, 'x')", "InvalidInput: value x already in unique column tag"),
        (1, "INSERT INTO notes VALUES (2, NULL, NULL), (3, NULL, NULL)", "INSERT 2"),
        (1, "DELETE FROM accounts WHERE id = 1", "InvalidInput: row referenced by notes.account = 1"),
        (1, "DROP TABLE accounts", "InvalidInput: table accounts is referenced from notes.account"),
        (1, "UPDATE notes SET account = 7", "InvalidInput: reference 7 not in table accounts"),
        (1, "SELECT * FROM notes ORDER BY id", "1, 1, x; 2, NULL, NULL; 3, NULL, NULL"),
        (1, "DELETE FROM notes", "DELETE 3"),
        (1, "DELETE FROM accounts", "DELETE 1"),
        (1, "DROP TABLE notes", "DROP TABLE"),
        (1, "DROP TABLE accounts", "DROP TABLE"),
    ),
    "conflict_error": _script(
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)", "CREATE TABLE"),
        (1, "INSERT INTO t VALUES (1, 10), (2, 20)", "INSERT 2"),
        (1, "BEGIN", "BEGIN"),
        (2, "BEGIN", "BEGIN"),
        (1, "UPDATE t SET v = 11 WHERE id = 1", "UPDATE 1"),
        (2, "UPDATE t SET v = 12 WHERE id = 1", "Serialization: serialization failure, retry transaction"),
        (2, "UPDATE t SET v = 21 WHERE id = 2", "UPDATE 1"),
        (1, "COMMIT", "COMMIT"),
        (2, "COMMIT", "COMMIT"),
        (1, "SELECT * FROM t ORDER BY id", "1, 11; 2, 21"),
    ),
    "ddl_outcomes": _script(
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "CREATE TABLE"),
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "InvalidInput: table t already exists"),
        (1, "CREATE TABLE u (a INTEGER)", "InvalidInput: no primary key for table u"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, b INTEGER PRIMARY KEY)", "InvalidInput: multiple primary keys for table u"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY NULL)", "InvalidInput: primary key a cannot be nullable"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, b INTEGER DEFAULT 1.5)", "InvalidInput: invalid default type FLOAT for INTEGER column b"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, b INTEGER NOT NULL DEFAULT NULL)", "InvalidInput: invalid NULL default for non-nullable column b"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, b INTEGER REFERENCES missing)", "InvalidInput: unknown table missing referenced by column b"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, b STRING REFERENCES t)", "InvalidInput: can't reference INTEGER primary key of t from STRING column b"),
        (1, "CREATE TABLE u (a INTEGER PRIMARY KEY, a STRING)", "InvalidInput: duplicate column a in table u"),
        (1, "DROP TABLE missing", "InvalidInput: table missing does not exist"),
        (1, "DROP TABLE IF EXISTS missing", "DROP TABLE"),
        (1, "DROP TABLE t", "DROP TABLE"),
        (1, "SELECT * FROM t", "InvalidInput: table t does not exist"),
        (1, "BEGIN", "BEGIN"),
        (1, "CREATE TABLE v (id INTEGER PRIMARY KEY)", "CREATE TABLE"),
        (2, "SELECT * FROM v", "InvalidInput: table v does not exist"),
        (1, "SELECT COUNT(*) FROM v", "0"),
        (1, "ROLLBACK", "ROLLBACK"),
        (1, "SELECT * FROM v", "InvalidInput: table v does not exist"),
    ),
    "transaction_states": _script(
        (1, "COMMIT", "InvalidInput: not in a transaction"),
        (1, "ROLLBACK", "InvalidInput: not in a transaction"),
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY, v STRING)", "CREATE TABLE"),
        (1, "BEGIN READ ONLY", "BEGIN"),
        (1, "BEGIN", "InvalidInput: already in a transaction"),
        (1, "INSERT INTO t VALUES (1, 'a')", "ReadOnly: read-only transaction"),
        (1, "CREATE TABLE u (id INTEGER PRIMARY KEY)", "ReadOnly: read-only transaction"),
        (1, "COMMIT", "COMMIT"),
        (1, "BEGIN", "BEGIN"),
        (1, "INSERT INTO t VALUES (1, 'a')", "INSERT 1"),
        (1, "INSERT INTO t VALUES (1, 'b')", "InvalidInput: primary key 1 already exists"),
        (1, "SELECT * FROM t", "1, a"),
        (2, "SELECT COUNT(*) FROM t", "0"),
        (1, "COMMIT", "COMMIT"),
        (2, "SELECT * FROM t", "1, a"),
        (1, "BEGIN", "BEGIN"),
        (1, "DELETE FROM t", "DELETE 1"),
        (1, "ROLLBACK", "ROLLBACK"),
        (1, "SELECT * FROM t", "1, a"),
        (1, "BEGIN READ ONLY AS OF SYSTEM TIME 999", "InvalidInput: version 999 does not exist"),
        (1, "BEGIN AS OF SYSTEM TIME 1", "InvalidInput: can't start read-write transaction in a given version"),
    ),
    "anomalies": _script(
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY, v STRING)", "CREATE TABLE"),
        (1, "INSERT INTO t VALUES (1, 'a'), (2, 'b')", "INSERT 2"),
        (1, "BEGIN", "BEGIN"),
        (2, "BEGIN", "BEGIN"),
        (1, "UPDATE t SET v = 'dirty' WHERE id = 1", "UPDATE 1"),
        (2, "SELECT * FROM t ORDER BY id", "1, a; 2, b"),
        (2, "UPDATE t SET v = 'lost' WHERE id = 1", "Serialization: serialization failure, retry transaction"),
        (1, "INSERT INTO t VALUES (3, 'phantom')", "INSERT 1"),
        (1, "COMMIT", "COMMIT"),
        (2, "SELECT * FROM t ORDER BY id", "1, a; 2, b"),
        (2, "UPDATE t SET v = 'skew' WHERE id = 2", "UPDATE 1"),
        (2, "COMMIT", "COMMIT"),
        (3, "SELECT * FROM t ORDER BY id", "1, dirty; 2, skew; 3, phantom"),
    ),
    "dml_counts": _script(
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER INDEX)", "CREATE TABLE"),
        (1, "INSERT INTO t VALUES (1, 5), (2, 5), (3, NULL)", "INSERT 3"),
        (1, "UPDATE t SET v = 6 WHERE v = 5", "UPDATE 2"),
        (1, "SELECT id FROM t WHERE v = 5", ""),
        (1, "SELECT id FROM t WHERE v = 6 ORDER BY id", "1; 2"),
        (1, "UPDATE t SET v = 7 WHERE FALSE", "UPDATE 0"),
        (1, "UPDATE t SET id = id + 10 WHERE id = 3", "UPDATE 1"),
        (1, "UPDATE t SET id = 1 WHERE id = 2", "InvalidInput: primary key 1 already exists"),
        (1, "DELETE FROM t WHERE v IS NULL", "DELETE 1"),
        (1, "DELETE FROM t", "DELETE 2"),
        (1, "SELECT COUNT(*) FROM t", "0"),
    ),
    "name_errors": _script(
        (1, "CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)", "CREATE TABLE"),
        (1, "CREATE TABLE u (id INTEGER PRIMARY KEY, w INTEGER)", "CREATE TABLE"),
        (1, "INSERT INTO t VALUES (1, 2), (3, 2)", "INSERT 2"),
        (1, "SELECT id FROM t, u", "InvalidInput: ambiguous column id"),
        (1, "SELECT * FROM t, t", "InvalidInput: duplicate table name t"),
        (1, "SELECT x FROM t", "InvalidInput: unknown column x"),
        (1, "SELECT x.id FROM t", "InvalidInput: unknown table x"),
        (1, "SELECT id FROM t GROUP BY v", "InvalidInput: column id must be used in an aggregate or GROUP BY expression"),
        (1, "SELECT id", "InvalidInput: expression must be constant, found column id"),
        (1, "SELECT v FROM t WHERE SUM(v) > 1", "InvalidInput: aggregate functions not allowed in WHERE"),
        (1, "SELECT SUM(MAX(v)) FROM t", "InvalidInput: aggregate functions can't be nested"),
        (1, "SELECT v, SUM(id), SUM(id) + 1 FROM t GROUP BY v, v", "2, 4, 5"),
        (1, "SELECT t.id AS v FROM t ORDER BY v DESC", "3; 1"),
        (1, "SELECT id FROM t HAVING id > 1", "InvalidInput: HAVING requires GROUP BY or aggregate function"),
    ),
    "float_groups": _script(
        (1, "CREATE TABLE g (id INTEGER PRIMARY KEY, f FLOAT)", "CREATE TABLE"),
        (1, "INSERT INTO g VALUES (1, NAN), (2, NAN), (3, 0.0), (4, -0.0), (5, NULL), (6, NULL), (7, INFINITY)", "INSERT 7"),
        (1, "SELECT f, COUNT(*) FROM g GROUP BY f ORDER BY COUNT(*) DESC, MIN(id)", "nan, 2; 0.0, 2; NULL, 2; inf, 1"),
        (1, "SELECT COUNT(*) FROM g a JOIN g b ON a.f = b.f", "5"),
        (1, "SELECT f FROM g ORDER BY f, id", "NULL; NULL; 0.0; 0.0; inf; nan; nan"),
    ),
}
_SMALL = "SELECT CAST(1 AS BIGINT) AS id, 'a' AS name, CAST(NULL AS BIGINT) AS nation, CAST(1.5 AS DOUBLE) AS balance, 'none' AS segment"
WRITES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "insert_rows": (_after("INSERT INTO accounts VALUES (900001, 'new', 1 + 1, 2.5, 'X'), (900002, 'newer', NULL, -1.0, NULL)"), f"{LOADED} UNION ALL SELECT 900001, 'new', 2, 2.5, 'X' UNION ALL SELECT 900002, 'newer', NULL, -1.0, NULL"),
    "insert_defaults": (_after("INSERT INTO accounts VALUES (1, 'a'), (2, 'b', 7), (3, 'c', 8, NULL, NULL)", load=False), f"{_SMALL} UNION ALL SELECT 2, 'b', 7, 1.5, 'none' UNION ALL SELECT 3, 'c', 8, NULL, NULL"),
    "insert_column_map": (_after("INSERT INTO accounts (segment, name, id) VALUES ('s', 'a', 1)", load=False), "SELECT CAST(1 AS BIGINT) AS id, 'a' AS name, CAST(NULL AS BIGINT) AS nation, CAST(1.5 AS DOUBLE) AS balance, 's' AS segment"),
    "update_where": (_after("UPDATE accounts SET segment = 'rich', nation = DEFAULT WHERE balance > 5000"), f"SELECT id, name, CASE WHEN balance > 5000 THEN NULL ELSE nation END AS nation, balance, CASE WHEN balance > 5000 THEN 'rich' ELSE segment END AS segment FROM ({LOADED})"),
    "update_expr_old_row": (_after("UPDATE accounts SET balance = balance * 2, nation = nation + id WHERE balance < 0"), f"SELECT id, name, CASE WHEN balance < 0 THEN nation + id ELSE nation END AS nation, CASE WHEN balance < 0 THEN balance * 2 ELSE balance END AS balance, segment FROM ({LOADED})"),
    "update_pk": (_after("UPDATE accounts SET id = id - 1"), f"SELECT id - 1 AS id, name, nation, balance, segment FROM ({LOADED})"),
    "delete_where": (_after("DELETE FROM accounts WHERE balance < 0 OR nation % 2 = 1"), f"SELECT * FROM ({LOADED}) WHERE NOT (balance < 0 OR nation % 2 = 1)"),
    "delete_all": (_after("DELETE FROM accounts"), f"SELECT * FROM ({LOADED}) WHERE FALSE"),
    "commit_visible": (_two_sessions(["BEGIN", "UPDATE accounts SET balance = 0.5 WHERE id < 10"], [], ["COMMIT"], False), f"SELECT id, CASE WHEN id < 10 THEN 0.5 ELSE balance END AS balance FROM ({LOADED})"),
    "rollback_invisible": (_two_sessions(["BEGIN", "UPDATE accounts SET balance = 0.5 WHERE id < 10"], [], ["ROLLBACK"], False), f"SELECT id, balance FROM ({LOADED})"),
    "snapshot_read": (_two_sessions(["BEGIN READ ONLY"], ["UPDATE accounts SET balance = 0.5"], [], True), f"SELECT id, balance FROM ({LOADED})"),
    "read_own_writes": (_two_sessions(["BEGIN", "DELETE FROM accounts WHERE id < 5", "UPDATE accounts SET balance = 0.5 WHERE id = 6"], [], [], True), f"SELECT id, CASE WHEN id = 6 THEN 0.5 ELSE balance END AS balance FROM ({LOADED}) WHERE id >= 5"),
    "as_of_read": (as_of_read, LOADED),
    "explain_plan": (explain_plan, None),
    "show_create": (show_create, _SHOWN),
    **SCRIPTS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _statement(s) for n, (s, _) in REGISTRY.items()} | {n: f for n, (f, _) in WRITES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: twin or s for n, (s, twin) in REGISTRY.items()} | {n: s for n, (_, s) in WRITES.items() if s}
