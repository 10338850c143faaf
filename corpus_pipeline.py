"""The corpus pipeline: each stage works on all that its predecessor kept.

Rejected documents go in the toxicity stage; later copies of repeated line
runs are cut, and a document that loses all its lines goes; of each component
of near duplicates (five words, 0.8) the document with the least doc_id stays;
benchmark passages are cut and contaminated documents go; what is left is
packed. Null and empty texts pass all stages and are packed as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import decontaminate, line_dedup, minhash, packing, toxicity
from quartzite.llm.common import fresh, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity_score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those that lose all they had go."""
    cut = line_dedup.dedup_lines(docs)
    n_removed = cut.columns[-1]
    return cut.where((F.col(n_removed) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that which names it. Of rows that repeat doc_id and a text with words, one stays."""
    found = saved(minhash.near_duplicates(docs, size=5, similarity=0.8), "near-copies")
    named = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = saved(named.groupBy(F.col("doc_id").alias("d"), "tk").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")), "stay")
    again = (F.col("rows") > 1) & (F.col("n") > 0)

    def of(these: DataFrame) -> DataFrame:
        return docs.join(these, docs["doc_id"].eqNullSafe(these["d"]) & (F.xxhash64(docs["text"]) == these["tk"]), "left_semi")

    if stay.where(again).isEmpty():
        return of(stay)
    return of(stay.where(~again)).unionByName(of(stay.where(again)).dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without hit spans."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.where(~F.col(clean.columns[-1])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]
#: The first and the last stage learn or tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
