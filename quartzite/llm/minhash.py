"""b-bit MinHash near-duplicate detection with exact confirmation.

Documents with equal sets of word shingles are one class. Each class has
`bands * ROWS` minima; bands of ROWS full minima give bucket keys, and the two
low bits of every minimum are packed as bit planes. A pair of classes that
share a bucket is a candidate; its similarity is estimated from the count of
differing bits, corrected for chance collisions (a quarter of unequal minima
agree in two bits), and a pair whose estimate is within six standard
deviations of the threshold is confirmed on its full sets of 64-bit shingle
hashes. A pair at the threshold shares no bucket with a probability under
1e-6.

Never are all pairs of a bucket made. Linked classes become components, so:
1. each bucket compares its members with one head; links make components;
2. buckets that still hold several components compare their members with a
   head of another choice, HEADS times, in one go;
3. what is left in such buckets is compared across components only, after
   classes that cannot be linked with anything were set aside: a shingle that
   occurs in no other class bounds a class's similarity with every other one,
   and counts of the other shingles by hash cells bound that of a pair.
Step 3 is exact for all candidates, so no link between candidates is lost.

Words: A-Z lower-cased, runs of anything but ASCII white space. Defined cases:
fewer words than a shingle make one shingle of the whole; null, empty and
blank texts have no shingles and are linked with nothing; rows that repeat a
doc_id are documents of their own; a null doc_id never gives a component its
name unless all of its documents have none; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, saved
from .components import components

ROWS, MISS, HEADS, SIGMAS, CELLS = 5, 1e-6, 3, 6, 64
CACHED_WORDS, AT_ONCE = 200_000, 40_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def n_bands(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))) if similarity < 1 else 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept for reuse."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    if len(_words) > CACHED_WORDS:
        _words.clear()
    split = [t.lower().split() for t in texts]
    flat = np.fromiter((h for ws in split for h in map(_words.__getitem__, ws)), np.uint64)
    joined = np.zeros(len(flat), np.uint64)
    for i in range(min(size, len(flat))):
        joined[: len(flat) - i] += _mix(flat[i:] + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
    joined = _mix(joined)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= size:
            out.append(np.unique(joined[at : at + n - size + 1]))
        elif n:
            whole = sum(int(h) * (2 * i + 3) for i, h in enumerate(flat[at : at + n])) + n
            out.append(_mix(np.array([whole & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _task(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task yields; the worker's words go when it ends."""
    with dropped(_words):
        yield from out


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, held = [], 0
    for t in texts:
        chunk.append(t)
        held += len(t)
        if held > 8 * AT_ONCE:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def signatures(docs: DataFrame, size: int, bands: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, tk (hash of the text), n (set size), c (class, null without shingles), keys (one a band), sig (bit planes)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("tk"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind, n_hashes = d.schema["doc_id"].dataType.simpleString(), bands * ROWS
    planes = -(-n_hashes // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _task(signed(batches))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        xors = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
        odds = rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        salt = _mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64)).reshape(bands, ROWS) | np.uint64(1)
        for b in batches:
            row = 0
            for chunk in _chunks(b.column("text").to_pylist()):
                sets = shingle_sets(chunk, size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(n)
                ca = np.zeros(len(sets), np.uint64)
                cb = np.zeros(len(sets), np.uint64)
                keys = np.zeros((len(sets), bands), np.uint64)
                sig = np.zeros((len(sets), 2 * planes), np.uint64)
                if len(full):
                    h = np.concatenate([sets[i] for i in full])
                    start = np.cumsum(n[full]) - n[full]
                    ca[full] = _mix(np.add.reduceat(_mix(h ^ _M2), start) + n[full].astype(np.uint64))
                    cb[full] = _mix(np.add.reduceat(_mix(h ^ _M1), start) + n[full].astype(np.uint64))
                    low = (h >> np.uint64(17)).astype(np.uint32)
                    minima = np.empty((n_hashes, len(full)), np.uint32)
                    for at in _cuts(n[full]):
                        part = low[start[at[0]] : start[at[1] - 1] + n[full][at[1] - 1]]
                        first = start[at[0] : at[1]] - start[at[0]]
                        for j in range(n_hashes):
                            minima[j, at[0] : at[1]] = np.minimum.reduceat((part ^ xors[j]) * odds[j], first)
                    wide = minima.astype(np.uint64).reshape(bands, ROWS, len(full))
                    keys[full] = _mix((_mix(wide + salt[:, :, None]) * salt[:, :, None]).sum(1)).T
                    for j in range(n_hashes):
                        for bit in (0, 1):
                            sig[full, 2 * (j // 64) + bit] |= ((minima[j] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64) << np.uint64(j % 64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(row, len(sets)),
                        b.column("tk").slice(row, len(sets)),
                        pa.array(n),
                        pa.StructArray.from_arrays([pa.array(_signed(ca)), pa.array(_signed(cb))], names=["a", "b"], mask=pa.array(n == 0)),
                        pa.array(list(_signed(keys)), pa.list_(pa.int64())),
                        pa.array(list(_signed(sig)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tk", "n", "c", "keys", "sig"],
                )
                row += len(sets)

    bounded_batches(docs.sparkSession)
    return d.mapInArrow(run, f"doc_id {kind}, tk long, n long, c struct<a:long,b:long>, keys array<long>, sig array<long>")


def _cuts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sets with about AT_ONCE shingles in all, so that the work stays in the processor's cache."""
    at = held = 0
    for i, x in enumerate(n.tolist()):
        held += x
        if held > AT_ONCE:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(n):
        yield at, len(n)


def estimate(a: Column, b: Column, n_hashes: int) -> Column:
    """Similarity from packed two-bit minima: the share of equal ones, less the quarter of unequal ones that agree by chance."""
    planes = -(-n_hashes // 64)
    differ = F.lit(0)
    for p in range(planes):
        low = F.get(a, F.lit(2 * p)).bitwiseXOR(F.get(b, F.lit(2 * p)))
        high = F.get(a, F.lit(2 * p + 1)).bitwiseXOR(F.get(b, F.lit(2 * p + 1)))
        differ = differ + F.bit_count(low.bitwiseOR(high))
    return 1 - differ / F.lit(n_hashes * 0.75)


def _lowest_estimate(similarity: float, n_hashes: int) -> float:
    p = similarity + (1 - similarity) / 4
    return similarity - SIGMAS * math.sqrt(p * (1 - p) / n_hashes) / 0.75


def _linked(inter: Column, a: Column, b: Column, similarity: float) -> Column:
    """inter / union >= similarity in whole numbers."""
    parts = round(similarity * 10_000)
    return inter * 10_000 >= (a + b - inter) * parts


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, tk (hash of its text), n_shingles, component_id (least doc_id of its component)."""
    bands = n_bands(similarity)
    s = saved(signatures(docs, size, bands, doc_id, text), "signatures")
    place = F.struct("doc_id", "tk")
    first = F.min_by(F.struct("doc_id", "tk", "n", "keys", "sig"), place).alias("r")
    classes = saved(s.where("n > 0").groupBy("c").agg(first, F.min("doc_id").alias("label")).select("c", "label", "r.*"), "classes")
    links = class_links(docs, classes, size, similarity, bands, doc_id, text)
    comp = classes.select("c", "label").join(links, F.col("c") == F.col("node"), "left").select("c", "label", F.coalesce("comp", "c").alias("comp"))
    comp = saved(comp, "comp")  # plain tables on both sides of each join: a component may hold many classes, a class many documents
    least = saved(comp.groupBy("comp").agg(F.min("label").alias("component_id")), "least")
    named = saved(comp.join(least, "comp").select("c", "component_id"), "named")
    out = s.select("doc_id", "tk", F.col("n").alias("n_shingles"), "c").join(named, "c", "left")
    return out.select("doc_id", "tk", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def class_links(docs: DataFrame, classes: DataFrame, size: int, similarity: float, bands: int, doc_id: str, text: str) -> DataFrame:
    """Components (node, comp) of the classes that have links with other classes. classes: a written table."""
    n_hashes = bands * ROWS
    members = classes.select("c", F.explode("keys").alias("key"))
    heads = members.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("head")).where("k > 1").drop("k")
    heads = saved(heads, "heads")  # a plain table, so that Spark may split a large bucket in the join
    members = saved(members.join(heads, "key"), "buckets")
    need = members.select("c").distinct()
    facts = saved(classes.select("c", "doc_id", "tk", "n", "sig").join(need, "c", "left_semi"), "facts")
    sets = saved(_sets(docs, facts, size, doc_id, text), "sets")
    if sets.count() > facts.count():  # the table repeats rows
        sets = saved(sets.dropDuplicates(["c"]), "sets")
    pairs = members.where("c != head").select(F.col("c").alias("u"), F.col("head").alias("v")).distinct()
    links = saved(_confirmed(pairs, facts, sets, similarity, n_hashes), "links")
    comp = saved(components(links), "components")
    open_ = _open(members.select("key", "c"), comp)
    if open_.isEmpty():
        return comp
    salted = open_.select("*", F.explode(F.sequence(F.lit(1), F.lit(HEADS))).alias("salt"))
    other = saved(salted.groupBy("key", "salt").agg(F.min(F.struct(F.xxhash64("salt", "c").alias("h"), "c", "comp")).alias("head")), "heads")
    pairs = salted.join(other, ["key", "salt"]).where("comp != head.comp").select(F.col("c").alias("u"), F.col("head.c").alias("v"))
    more = _confirmed(_ordered(pairs), facts, sets, similarity, n_hashes)
    links = saved(links.unionByName(more), "links")
    comp = saved(components(links), "components")
    open_ = _open(open_.select("key", "c"), comp)
    if open_.isEmpty():
        return comp
    pairs = _across(open_, facts, sets, similarity, n_hashes)
    more = saved(_confirmed(pairs, facts, sets, similarity, n_hashes), "links")
    if more.isEmpty():
        return comp
    return saved(components(links.unionByName(more)), "components")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, c, comp) of the buckets that hold more than one component."""
    m = saved(members.join(comp, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("comp", "c").alias("comp")), "labelled")
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    mixed = saved(mixed, "mixed")
    return saved(m.join(mixed, "key"), "open")


def _sets(docs: DataFrame, facts: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """The shingle sets of the classes in facts, from the whole text of one document of each: c, shingles."""
    d = docs.select(F.col(doc_id).alias("d_id"), F.col(text).cast("string").alias("text")).withColumn("d_tk", F.xxhash64("text"))
    f = facts.select("c", "doc_id", "tk")
    j = d.join(f, d["d_id"].eqNullSafe(f["doc_id"]) & (d["d_tk"] == f["tk"])).select("c", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _task(shingled(batches))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for chunk in _chunks(b.column("text").to_pylist()):
                sets = [_signed(x) for x in shingle_sets(chunk, size)]
                yield pa.RecordBatch.from_arrays([b.column("c").slice(row, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])
                row += len(sets)

    return j.mapInArrow(run, "c struct<a:long,b:long>, shingles array<long>")


def _confirmed(pairs: DataFrame, facts: DataFrame, sets: DataFrame, similarity: float, n_hashes: int) -> DataFrame:
    """The pairs (u, v) whose estimate is near the threshold or over it and whose full sets are linked."""
    a = facts.select(F.col("c").alias("u"), F.col("n").alias("n_u"), F.col("sig").alias("sig_u"))
    b = facts.select(F.col("c").alias("v"), F.col("n").alias("n_v"), F.col("sig").alias("sig_v"))
    sizes = _linked(F.least("n_u", "n_v"), F.col("n_u"), F.col("n_v"), similarity)
    p = pairs.join(a, "u").join(b, "v").where(sizes & (estimate(F.col("sig_u"), F.col("sig_v"), n_hashes) >= _lowest_estimate(similarity, n_hashes)))
    p = p.select("u", "v", "n_u", "n_v")
    p = p.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("s_u")), "u").join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("s_v")), "v")
    inter = F.size(F.array_intersect("s_u", "s_v")).cast("long")
    return p.where(_linked(inter, F.col("n_u"), F.col("n_v"), similarity)).select("u", "v")


def _across(members: DataFrame, facts: DataFrame, sets: DataFrame, similarity: float, n_hashes: int) -> DataFrame:
    """Candidate pairs of different components in a bucket, without those that counts of shingles rule out.

    A shingle of one class alone is in no intersection. The other shingles of
    a class are counted by CELLS hash cells, and an intersection holds at most
    the lesser count of each cell. Copies of one text that were changed in
    different places lose shingles in different cells, so this bound comes
    near to their true similarity and leaves few pairs that are no links.
    """
    c = members.select("c").distinct()
    own = sets.join(c, "c", "left_semi")
    lone = own.select("c", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c"))
    lone = lone.where("k = 1").groupBy("c").agg(F.collect_list("h").alias("lone"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for every, alone in zip(b.column("shingles"), b.column("lone"), strict=True):
                n = np.bincount(every.values.to_numpy() & (CELLS - 1), minlength=CELLS)
                if alone.is_valid:
                    n -= np.bincount(alone.values.to_numpy() & (CELLS - 1), minlength=CELLS)
                cells.append(n)
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array([int(n.sum()) for n in cells], pa.int64()), pa.array(cells, pa.list_(pa.int32()))], names=["c", "rest", "cells"])

    rest = own.join(lone, "c", "left").mapInArrow(count, "c struct<a:long,b:long>, rest long, cells array<int>")
    f = facts.select("c", "n", "sig").join(rest, "c")
    f = saved(f.where(_linked(F.col("rest"), F.col("rest"), F.col("n"), similarity)), "lone")
    m = saved(members.join(f, "c"), "bounded")
    # In each bucket, the least size of a partner: who cannot reach even that one is done with the bucket.
    least = saved(m.groupBy("key").agg(F.min("n").alias("least")), "least")
    partner = F.greatest("rest", "least")
    m = saved(m.join(least, "key").where(_linked(F.col("rest"), partner, F.col("n"), similarity)), "rest")
    # A pair of two components has a side outside the bucket's largest one: that side meets all, so that no component meets itself.
    sizes = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("most"))
    m = saved(m.join(saved(sizes.select("key", F.col("most.comp").alias("largest")), "largest"), "key"), "sided")
    names = ("c", "comp", "n", "rest", "sig", "cells", "largest")
    a = m.where("comp != largest").select("key", *(F.col(x).alias(f"{x}_a") for x in names))
    b = m.select("key", *(F.col(x).alias(f"{x}_b") for x in names))
    near = estimate(F.col("sig_a"), F.col("sig_b"), n_hashes) >= _lowest_estimate(similarity, n_hashes)
    common = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda n, x: n + x)
    j = a.join(
        b,
        (a["key"] == b["key"])
        & (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("largest_b")) | (F.col("c_a") > F.col("c_b")))
        & _linked(F.least("rest_a", "rest_b"), F.col("n_a"), F.col("n_b"), similarity)
        & near
        & _linked(common, F.col("n_a"), F.col("n_b"), similarity),
    )
    return _ordered(j.select(F.col("c_a").alias("u"), F.col("c_b").alias("v")))
