"""Operators of the dialect: values, NULL, NaN, infinities, overflow and type errors."""

import math

import pytest

from quartzite.errors import InvalidInput
from quartzite.plans.parser import parse_expression
from quartzite.session import Engine

INF = math.inf

VALUES = {
    "logic": [
        ("TRUE AND TRUE", True), ("TRUE AND FALSE", False), ("FALSE AND NULL", False), ("NULL AND TRUE", None), ("NULL AND NULL", None),
        ("TRUE OR NULL", True), ("NULL OR FALSE", None), ("FALSE OR FALSE", False), ("NOT TRUE", False), ("NOT NULL", None), ("NOT NOT TRUE", True),
    ],
    "equality": [
        ("1 = 1", True), ("1 = 1.0", True), ("1 = 2", False), ("'a' = 'a'", True), ("'a' = 'A'", False), ("TRUE = TRUE", True), ("TRUE = FALSE", False),
        ("NULL = NULL", None), ("1 = NULL", None), ("NAN = NAN", False), ("NAN = NULL", None), ("NULL = NAN", None), ("INFINITY = INFINITY", True),
        ("INFINITY = -INFINITY", False), ("-0.0 = 0.0", True), ("NAN != NAN", True), ("1 != 1", False), ("1 <> 2", True), ("NULL != NULL", None),
    ],
    "order": [
        ("1 > 0", True), ("1 > 1", False), ("1.5 > 1", True), ("'b' > 'a'", True), ("'B' > 'a'", False), ("TRUE > FALSE", True), ("NAN > 1", False),
        ("NAN > NAN", False), ("1 > NAN", False), ("INFINITY > 1", True), ("NULL > 1", None), ("NAN > NULL", None), ("1 < NAN", False), ("-INFINITY < 0", True),
        ("1 >= 1", True), ("NAN >= NAN", False), ("'a' <= 'a'", True), ("2 <= 1", False), ("FALSE < TRUE", True),
    ],
    "is": [
        ("NULL IS NULL", True), ("1 IS NULL", False), ("NAN IS NULL", False), ("1 IS NOT NULL", True), ("NAN IS NAN", True), ("1.0 IS NAN", False),
        ("NULL IS NAN", None), ("1.0 IS NOT NAN", True), ("NULL IS NOT NAN", None), ("1 = 1 IS NULL", False),
    ],
    "sums": [
        ("1 + 2", 3), ("1 + 2.5", 3.5), ("1 + NULL", None), ("INFINITY + 1", INF), ("INFINITY - INFINITY", math.nan), ("1 - 2", -1), ("2 * 3", 6),
        ("2.0 * 3", 6.0), ("INFINITY * 0", math.nan), ("NAN * 1", math.nan), ("-9223372036854775807 - 1", -(2**63)),
    ],
    "division": [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / -2", -3), ("7.0 / 2", 3.5), ("1.0 / 0", INF), ("-1.0 / 0.0", -INF), ("1 / -0.0", -INF), ("0.0 / 0", math.nan),
        ("1 / INFINITY", 0.0), ("NULL / 0.0", None), ("1.0 / NULL", None), ("NAN / 0", math.nan), ("5 % 3", 2), ("-5 % 3", -2), ("5 % -3", 2), ("6.28 % 3.14", 0.0),
        ("3.0 % 0", math.nan), ("NULL % 0.0", None), ("5 % INFINITY", 5.0),
    ],
    "power": [
        ("2 ^ 3", 8), ("2 ^ -3", 0.125), ("2 ^ 0", 1), ("0 ^ 0", 1), ("2 ^ 62", 2**62), ("3 ^ 39", 3**39), ("-1 ^ 10000000000", 1), ("2.5 ^ 2", 6.25),
        ("4 ^ 0.5", 2.0), ("2 ^ NULL", None), ("NAN ^ 2", math.nan), ("INFINITY ^ 2", INF), ("2 ^ 3 ^ 2", 512), ("(2 ^ 3) ^ 2", 64),
    ],
    "factorial": [("0!", 1), ("3!", 6), ("20!", 2432902008176640000), ("NULL!", None), ("-0!", 1), ("2 ^ 3!", 64), ("3!!", 720)],
    "signs": [("-(1)", -1), ("--1", 1), ("+-1", -1), ("-1.5", -1.5), ("-NULL", None), ("+INFINITY", INF), ("-NAN", math.nan)],
    "like": [
        ("'abc' LIKE 'abc'", True), ("'abc' LIKE 'ABC'", False), ("'abc' LIKE 'a%'", True), ("'abc' LIKE '%b%'", True), ("'abc' LIKE '_b_'", True), ("'abc' LIKE 'ab'", False),
        ("'abc' LIKE ''", False), ("'' LIKE '%'", True), ("'a.c' LIKE 'a.c'", True), ("'abc' LIKE 'a.c'", False), ("'a\\b' LIKE 'a\\b'", True), ("'\\' LIKE '\\'", True), ("'日本' LIKE '_本'", True),
        ("NULL LIKE 'a'", None), ("'a' LIKE NULL", None),
    ],
    "sqrt": [("sqrt(4)", 2.0), ("sqrt(2.25)", 1.5), ("sqrt(0)", 0.0), ("sqrt(-1.0)", math.nan), ("sqrt(NULL)", None), ("sqrt(INFINITY)", INF)],
    "literals": [("1e3", 1000.0), ("1.5e-2", 0.015), ("3.", 3.0), ("1e400", INF), ("9223372036854775807", 2**63 - 1), ("'it''s'", "it's"), ("'Å👍'", "Å👍"), ("''", "")],
    "precedence": [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-3 ^ 2", 9), ("-(3 ^ 2)", -9), ("3 * 4 % 3", 0), ("8 / 4 % 3", 2), ("2 + 3!", 8), ("NOT 1 = 2", True),
        ("TRUE OR FALSE AND FALSE", True), ("1 + 2 > 2", True), ("1 > 2 = FALSE", True), ("NOT TRUE OR TRUE", True), ("3 - 2 + 1", 2),
    ],
}

TYPE_ERRORS = [
    "1 + TRUE", "'a' + 1", "TRUE AND 1", "NOT 1", "1 = 'a'", "TRUE > 1", "1 LIKE 'a'", "'a' LIKE 1", "1.5!", "'a'!", "-TRUE", "+'a'", "sqrt('a')", "1 IS NAN", "'a' IS NAN",
    "unknown(1)", "sqrt()", "sqrt(1, 2)", "1 +", "a", "9223372036854775808", "'open", "1 2", "(1", "1 IS 2",
]

RUNTIME_ERRORS = ["1 / 0", "1 % 0", "9223372036854775807 + 1", "-9223372036854775807 - 2", "2 ^ 63", "21!", "(0 - 1)!", "sqrt(-1)", "9223372036854775807 * 2"]


def same(a, b) -> bool:
    if isinstance(b, float) and not isinstance(a, bool) and a is not None:
        return isinstance(a, float) and ((math.isnan(a) and math.isnan(b)) or math.isclose(a, b, abs_tol=1e-12))
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("group", VALUES)
def test_values(spark, group):
    cases = VALUES[group]
    row = Engine(spark).session().execute("SELECT " + ", ".join(e for e, _ in cases)).one()
    wrong = [(e, got, want) for (e, want), got in zip(cases, row, strict=True) if not same(got, want)]
    assert not wrong


def test_type_errors_are_found_without_running(spark):
    session = Engine(spark).session()
    for e in TYPE_ERRORS:
        with pytest.raises(InvalidInput):
            session.execute(f"SELECT {e}")


@pytest.mark.parametrize("e", RUNTIME_ERRORS)
def test_runtime_errors(spark, e):
    with pytest.raises(Exception, match="(?i)overflow|zero|factorial|square root"):
        Engine(spark).session().execute(f"SELECT {e}").rows()


def test_columns_follow_the_rules_of_constants(spark):
    """The same comparisons over columns, which Catalyst cannot fold."""
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, nan, None), (2, 0.0, 2.0, 5.0), (3, None, nan, nan)], "id long, a double, b double, c double")
    engine = Engine(spark)
    engine.register("t", df)
    got = engine.session().sql("SELECT id, a = b AS x, b = b AS y, b > a AS z, a < b AS w, b = c AS v, a / 0 AS d, 1 / a AS e, a % 0 AS m, id ^ 2 AS p, id! AS f FROM t ORDER BY id").collect()
    assert [tuple(r)[1:6] for r in got] == [(False, False, False, False, None), (False, True, True, True, False), (None, False, None, None, False)]
    assert got[0].d == INF and math.isnan(got[1].d) and got[2].d is None
    assert got[1].e == INF and math.isnan(got[0].m) and [r.p for r in got] == [1, 4, 9] and [r.f for r in got] == [1, 2, 6]


def test_equal_trees():
    assert parse_expression("1 + NAN") == parse_expression("1+nan")
    assert parse_expression("a.b % 2") != parse_expression("b % 2")
