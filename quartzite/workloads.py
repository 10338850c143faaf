"""The three transactional workloads in batch form: N lookups, N inserted rows, N transfers, one statement each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidData
from .session import Engine, Session


def read(spark: SparkSession, root: str, rows: int = 1000, lookups: int = 100_000) -> DataFrame:
    """Look up random ids, by an equi join of the batch with the table; every lookup must find its row."""
    session = Engine(spark, root).session()
    session.execute("CREATE TABLE \"read\" (id INT PRIMARY KEY, value STRING NOT NULL)")
    session.insert_dataframe("read", spark.range(1, rows + 1).select("id", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 64).alias("value")))
    wanted = spark.range(lookups).select((F.pmod(F.xxhash64("id"), F.lit(rows)) + 1).alias("id"))
    session.engine.register("wanted", wanted)
    found = session.sql("SELECT r.id, r.value FROM wanted w JOIN \"read\" r ON w.id = r.id")
    if found.count() != lookups:
        raise InvalidData("a lookup found no row")
    return found


def write(spark: SparkSession, root: str, rows: int = 100_000) -> DataFrame:
    """Insert rows with sequential ids; the table must hold them all."""
    session = Engine(spark, root).session()
    session.execute("CREATE TABLE \"write\" (id INT PRIMARY KEY, value STRING NOT NULL)")
    session.insert_dataframe("write", spark.range(1, rows + 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("value")))
    out = session.sql("SELECT COUNT(*) AS n FROM \"write\"")
    if out.first()[0] != rows:
        raise InvalidData("rows are missing")
    return out


def bank(spark: SparkSession, root: str, customers: int = 100, accounts: int = 10, balance: int = 100, most: int = 50, transfers: int = 1000) -> DataFrame:
    """Transfers between the richest account of one customer and the poorest of another, netted in one update; money is conserved."""
    session = Engine(spark, root).session()
    session.execute("CREATE TABLE customer (id INT PRIMARY KEY, name STRING NOT NULL)")
    session.execute("CREATE TABLE account (id INT PRIMARY KEY, customer_id INT NOT NULL INDEX REFERENCES customer, balance INT NOT NULL)")
    session.insert_dataframe("customer", spark.range(1, customers + 1).select("id", F.concat(F.lit("customer "), "id").alias("name")))
    ids = spark.range(customers * accounts)
    session.insert_dataframe("account", ids.select((F.col("id") + 1).alias("id"), (F.col("id") % customers + 1).alias("customer_id"), F.lit(balance).cast("long").alias("balance")))
    _transfer(session, customers, most, transfers)
    out = session.sql("SELECT c.id, SUM(a.balance) AS total, MIN(a.balance) AS least FROM customer c JOIN account a ON a.customer_id = c.id GROUP BY c.id")
    if out.agg(F.sum("total")).first()[0] != customers * accounts * balance:
        raise InvalidData("money was lost or made")
    return out


def _transfer(session: Session, customers: int, most: int, transfers: int) -> None:
    spark = session.engine.spark
    session.execute("BEGIN")
    best = session.sql("SELECT customer_id, MAX(balance * 1000000 + id) AS top, MIN(balance * 1000000 + id) AS low FROM account GROUP BY customer_id")
    t = spark.range(transfers).select(
        (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(customers)) + 1).alias("giver"),
        (F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(customers)) + 1).alias("taker"),
        F.lit(1).cast("long").alias("amount"),
    )
    # What each pair moves is bounded, and a giver never gives more than its richest account has.
    flows = t.where("giver != taker").groupBy("giver", "taker").agg(F.least(F.sum("amount"), F.lit(most)).alias("amount"))
    rich = best.select(F.col("customer_id").alias("giver"), F.floor(F.col("top") / 1_000_000).alias("has"), F.col("top") % 1_000_000)
    share = flows.groupBy("giver").agg(F.sum("amount").alias("out")).join(rich.select("giver", "has"), "giver").select("giver", F.least(F.lit(1.0), F.col("has") / F.col("out")).alias("share"))
    flows = flows.join(share, "giver").select("giver", "taker", F.floor(F.col("amount") * F.col("share")).alias("amount"))
    give = flows.groupBy(F.col("giver").alias("customer_id")).agg((-F.sum("amount")).alias("change")).join(best, "customer_id").select((F.col("top") % 1_000_000).alias("id"), "change")
    take = flows.groupBy(F.col("taker").alias("customer_id")).agg(F.sum("amount").alias("change")).join(best, "customer_id").select((F.col("low") % 1_000_000).alias("id"), "change")
    session.merge_changes("account", give.unionByName(take).groupBy("id").agg(F.sum("change").alias("change")), "balance")
    session.execute("COMMIT")
