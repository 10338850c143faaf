"""Line dedup: a suffix array of the documents' lines by distributed prefix doubling; repeated runs lose their later copies.

Non-blank lines have identifiers, and every line starts a suffix of its
document's sequence of them. Round 0 ranks suffixes by their first line, round
k by their first 2^k lines: the pair (rank of the first half, rank of the half
that starts 2^(k-1) lines on) is formed by a window over the document, distinct
pairs are range-partitioned and sorted, and their place in that order, which
monotonically_increasing_id() numbers over all partitions, is the rank. An
equi join brings it back to the suffixes. A suffix whose pair no other shares
is told apart and leaves, so rounds shrink; they end when nobody is left, or
when 2^k lines are more than any prefix that is looked for.

An interval of the suffix array with a common prefix of n lines is a set of
suffixes with the same rank pair for the first n lines: the rank of the first
2^k, and of the 2^k that end with line n. Of each suffix, the prefixes looked
for are the shortest with min_words words or more, and the longer ones that end
before the shortest of the next suffix does; the end of any longer repeated run
is such a prefix of the last suffix that fits into it, so the union of these
is that of all maximal repeated runs (a line that is a prefix alone has
one with the next line too, for blank lines between them). A partial aggregate
gives each interval's size and first place (smallest doc_id, then line); all
its other suffixes start later copies, whose lines are deleted.

A line or passage that a third of all documents share is one row of the tables
of ranks and intervals, found by partial aggregates; the joins that return to
the suffixes have plain tables on both sides, which Spark may split. What is
grouped by document is no more than the document. Every round is written to the
shared folder.

Defined cases: null text stays null and has no lines; an empty text stays
empty; lines are compared after trimming white space; blank lines start no
run and go only inside one; a line's words are its inner white-space
characters plus one; rows that repeat both doc_id and text share one
decision; a null doc_id sorts before all others; an empty table gives an
empty table; other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved

MIN_WORDS = 30


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, key (hash of the text), lines (the non-blank ones: at, words, and a 128-bit identifier a, b)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    trimmed = F.transform(_lines(F.col("text")), lambda s, i: F.struct(F.trim(F.regexp_replace(s, r"[\t\r\x0B\f]", " ")).alias("s"), i.alias("at")))

    def line(p: Column) -> Column:
        words = F.char_length(p["s"]) - F.char_length(F.replace(p["s"], F.lit(" "), F.lit(""))) + 1
        return F.struct(p["at"].alias("at"), words.cast("int").alias("words"), F.xxhash64(F.lit(0x51), p["s"]).alias("a"), F.xxhash64(F.lit(0xA7C3), p["s"]).alias("b"))

    return d.select("doc_id", F.xxhash64("text").alias("key"), F.transform(F.filter(trimmed, lambda p: p["s"] != ""), line).alias("lines"))


def _doubled(sums: Column, half: int) -> Column:
    """Words of the 2 * half lines from each place on, from those of half lines (nothing past the end)."""
    return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i + half), F.lit(0)))


def ranks(pairs: DataFrame, name: str) -> DataFrame:
    """The pairs that occur more than once, with their rank in sorted order (gaps between ranks mean nothing)."""
    a, b = pairs.columns
    shared = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b)
    return saved(shared.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()), name)


def first_ranks(lines: DataFrame, min_words: int) -> DataFrame:
    """Round 0: the suffixes whose first line is repeated, in stretches of repeated lines that hold min_words words or more.

    doc_id, key, j (place among the document's lines), first (line in the text), least (lines of the shortest prefix),
    ends (last line, in the text, of this prefix and of each longer one), rank.
    """
    levels = max(1, math.ceil(math.log2(max(2, min_words))))
    each = lines.select("doc_id", "key", F.posexplode("lines").alias("j", "l")).select("doc_id", "key", "j", "l.*")
    known = each.join(ranks(each.select("a", "b"), "line-ranks"), ["a", "b"]).select("doc_id", "key", "j", "at", "words", "rank")
    gaps = known.withColumn("stretch", F.col("j") - F.dense_rank().over(Window.partitionBy("doc_id", "key").orderBy("j")))
    s = gaps.groupBy("doc_id", "key", "stretch").agg(F.array_sort(F.collect_set(F.struct("j", "at", "words", "rank"))).alias("l"))
    s = s.where(F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + x["words"]) >= min_words)
    s = s.withColumn("w0", F.transform("l", lambda x: x["words"]))
    for k in range(levels):
        s = s.withColumn(f"w{k + 1}", _doubled(F.col(f"w{k}"), 1 << k))
    s = s.withColumn("w", F.array(*(F.col(f"w{k}") for k in range(levels + 1))))

    def need(i: Column) -> Column:
        """Lines that suffix i needs: from the largest power of two down, take a block while the words fall short."""

        def step(acc: Column, k: Column) -> Column:
            words = acc["words"] + F.coalesce(F.get(F.get("w", k), i + acc["len"]), F.lit(0))
            taken = F.struct((acc["len"] + F.pow(F.lit(2), k).cast("int")).alias("len"), words.alias("words"))
            return F.when(words < min_words, taken).otherwise(acc)

        start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("words"))
        return F.aggregate(F.array(*(F.lit(k) for k in range(levels, -1, -1))), start, step, lambda acc: acc["len"] + 1)

    s = s.withColumn("needs", F.transform("l", lambda _, i: need(i)))
    size = F.size("l")

    def suffix(x: Column, i: Column) -> Column:
        least = F.get("needs", i)
        most = F.greatest(least, F.least(size - i, F.greatest(F.coalesce(F.get("needs", i + 1), least), F.lit(2))))
        ends = F.when(i + least <= size, F.transform(F.sequence(least, most), lambda n: F.get("l", i + n - 1)["at"]))
        return F.struct(x["j"].alias("j"), x["at"].alias("first"), least.alias("least"), ends.alias("ends"), x["rank"].alias("rank"))

    return s.select("doc_id", "key", F.inline(F.transform("l", suffix)))


def _prefixes(k: int) -> Column:
    """Names of the wanted prefixes of 2^k to 2^(k+1) - 1 lines, from the ranks (following) of the 2^k next suffixes."""
    block = 1 << k
    low, high = F.greatest("least", F.lit(block)), F.least(F.col("least") + F.size("ends") - 1, F.lit(2 * block - 1))

    def name(n: Column) -> Column:
        then = F.get("following", n - block)
        return F.struct(n.alias("n"), F.get("ends", n - F.col("least")).alias("last"), F.col("rank").alias("a"), F.when(then["j"] == F.col("j") + n - block, then["rank"]).alias("b"))

    return F.when(F.col("ends").isNotNull() & (low <= high), F.filter(F.transform(F.sequence(low, high), name), lambda p: p["b"].isNotNull()))


def prefixes(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The wanted prefixes whose halves are shared: doc_id, key, first and last line in the text, and the name (n, a, b): lines and two ranks."""
    t = first_ranks(saved(line_table(docs, doc_id, text), "lines"), min_words)
    found, k = [], 0
    while True:
        block = 1 << k
        place = Window.partitionBy("doc_id", "key").orderBy("j")
        then = F.lead(F.struct("j", "rank"), block).over(place)
        t = t.withColumn("following", F.collect_list(F.struct("j", "rank")).over(place.rowsBetween(0, block - 1))).withColumn("then", then)
        other = F.when(F.col("then.j") == F.col("j") + block, F.col("then.rank"))
        t = saved(t.select("doc_id", "key", "j", "first", "least", "ends", "rank", other.alias("other"), _prefixes(k).alias("names")), "suffixes")
        found.append(t.where(F.size("names") > 0).select("doc_id", "key", "first", F.inline("names")))
        if 2 * block > max(2, min_words):
            break
        pairs = t.where("other IS NOT NULL").select("doc_id", "key", "j", "first", "least", "ends", F.col("rank").alias("a"), F.col("other").alias("b"))
        named = ranks(pairs.select("a", "b"), "ranks")
        if named.isEmpty():
            break
        t = pairs.join(named, ["a", "b"]).select("doc_id", "key", "j", "first", "least", "ends", "rank")
        k += 1
    return reduce(DataFrame.unionByName, found)


def intervals(p: DataFrame) -> DataFrame:
    """Intervals of two suffixes or more, written down: the name (n, a, b), and the place of the first."""
    place = F.struct("doc_id", "key", "first")
    i = p.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("suffixes"), F.min(place).alias("head"))
    return saved(i.where("suffixes > 1").drop("suffixes"), "intervals")


def later_copies(p: DataFrame) -> DataFrame:
    """Runs that begin at an earlier place too: doc_id, key, first, last."""
    j = p.join(intervals(p), ["n", "a", "b"]).where(~F.struct("doc_id", "key", "first").eqNullSafe(F.col("head")))
    return j.select("doc_id", "key", "first", "last")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut, and with n_lines and n_removed (in columns of these names or, where taken, with "_" added)."""
    runs = later_copies(prefixes(docs, min_words, doc_id, text))
    runs = runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    lost = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
    runs = saved(runs.select("doc_id", "key", lost.alias("lost")), "runs")
    key, cut, n_lines, n_removed = (fresh(docs, c) for c in ("line_key", "line_runs", "n_lines", "n_removed"))
    left = docs.withColumn(key, F.xxhash64(text))
    its_doc, its_key = fresh(docs, "line_doc"), fresh(docs, "line_text")
    runs = runs.select(F.col("doc_id").alias(its_doc), F.col("key").alias(its_key), F.col("lost").alias(cut))
    # Sorted and merged at every size: a broadcast of the runs would grow with the documents.
    runs = runs.hint("merge")
    j = left.join(runs, left[doc_id].eqNullSafe(runs[its_doc]) & (left[key] == runs[its_key]), "left")
    lines = _lines(F.col(text))
    # A flag a line up to the last that goes, so that the text is split once.
    flags = F.flatten(F.transform(cut, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(cut, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    kept = F.filter(F.zip_with(lines, flags, lambda s, f: F.when(~F.coalesce(f, F.lit(False)), s)), lambda s: s.isNotNull())
    out = [F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns]
    total = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines))
    return j.select(*out, total.cast("long").alias(n_lines), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(n_removed))
