"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are integers floor(256 * x). A task keeps, for blocks of its vectors,
a sorted list of each dimension's values. Queries read their lists in step,
from the top for positive and from the bottom for negative weights; the rows
met are scored in full (random access, a matrix product for all active
queries), and a query leaves a block when the sum of its weights times the
values at the present depth, an upper bound for all unseen rows, is below its
k-th best score. The k-th best is carried from block to block, so a later
block may be left at once. A tie with the bound goes on, as an unseen row with
a smaller id would win. Equal vectors are scored once and keep their k + 1
smallest ids.

Queries are sent to the tasks in blocks of at most QUERIES rows, one pass over
the vectors each: a stated query set against all rows, in blocks. A task
returns k rows a query, and a window over those gives the result.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite
component take no part as queries or candidates, nor do rows with a null id;
shorter vectors count as padded with zeros; rows that repeat both id and vector
count once, as candidates and as queries; a row is never a candidate for a
query of its id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved

SCALE, QUERIES, ROWS, AT_ONCE, FIRST_DEPTH = 256, 65_536, 8_192, 512, 16
_NO_ID, _NO_SCORE = np.iinfo(np.int64).max, -(1 << 62)


def quantized(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(wide) > 0) & ~bad, F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")))


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    n = np.diff(ends)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat[: int(n.sum())]
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), _NO_SCORE)
        self.found = np.full((len(ids), k), _NO_ID)

    def _offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.hstack([self.scores[q], scores]), np.hstack([self.found[q], ids])
        order = np.lexsort((ids, -scores), axis=1)
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        again = np.zeros(ids.shape, bool)  # a row that another block had too
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1]) & (ids[:, 1:] != _NO_ID)
        if again.any():
            scores[again], ids[again] = _NO_SCORE, _NO_ID
            order = np.argsort(again, axis=1, kind="stable")
            scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        self.scores[q], self.found[q] = scores[:, : self.k], ids[:, : self.k]

    def _score(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, exact: bool) -> None:
        """Score all of rows for queries q. ids: the k + 1 smallest ids of each row, ascending, sorted by the first."""
        v = self.vectors[q]
        s = (v.astype(float) @ rows.T.astype(float)).astype(np.int64) if exact else v @ rows.T
        m = min(self.k, len(rows))
        own = ids[np.isin(ids, self.ids[q])]
        if len(own):  # a query passes over the rows of its own id
            m = min(self.k + int(np.unique(own, return_counts=True)[1].max()), len(rows))
        # Rows are in the order of their ids, so among equal scores the first rows win.
        top = np.argsort(-s, axis=1, kind="stable")[:, :m] if not exact or len(rows) <= 4 * m else _first(s, m)
        for c in range(ids.shape[1]):
            found = ids[top, c]
            got = np.where((found == self.ids[q][:, None]) | (found == _NO_ID), _NO_SCORE, np.take_along_axis(s, top, 1))
            if (got > _NO_SCORE).any():
                self._offer(q, got, np.where(got > _NO_SCORE, found, _NO_ID))

    def search(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Threshold algorithm over one block of rows."""
        rows, ids = _classes(rows, ids, self.k + 1)
        n, d = rows.shape
        exact = int(np.abs(self.vectors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * d < 2**48
        order = np.argsort(rows, axis=0, kind="stable")
        lists = np.take_along_axis(rows, order, 0)
        up, down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        for part in range(0, len(self.ids), AT_ONCE):
            q = np.arange(part, min(part + AT_ONCE, len(self.ids)))
            seen = np.zeros(n, bool)
            depth, done = FIRST_DEPTH, 0
            q = q[up[q] @ lists[n - 1] + down[q] @ lists[0] >= self.scores[q, -1]]
            while len(q) and done < n:
                depth = min(depth, n)
                low = order[done:depth][:, (self.vectors[q] < 0).any(0)]
                high = order[n - depth : n - done][:, (self.vectors[q] > 0).any(0)]
                met = np.unique(np.concatenate([low.ravel(), high.ravel()]))
                met = met[~seen[met]]
                seen[met] = True
                if depth == n:
                    met = np.union1d(met, np.flatnonzero(~seen))
                if len(met):
                    self._score(q, rows[met], ids[met], exact)
                done, depth = depth, depth * 4
                bound = up[q] @ lists[n - done] + down[q] @ lists[done - 1]
                q = q[bound >= self.scores[q, -1]]
                if seen.all():
                    break


def _first(s: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m greatest of each row, the leftmost among equal ones."""
    key = s * s.shape[1] + np.arange(s.shape[1] - 1, -1, -1)
    return np.argpartition(-key, m - 1, axis=1)[:, :m]


def _classes(rows: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with the `keep` smallest ids of each, in order of the smallest."""
    rows, ids = (x := np.unique(np.hstack([rows, ids[:, None]]), axis=0))[:, :-1], x[:, -1]
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    new = np.empty(len(first), np.int64)
    new[np.argsort(first)] = np.arange(len(first))
    which, first = new[which], np.sort(first)
    order = np.argsort(which, kind="stable")
    n = np.bincount(which)
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((len(first), min(keep, int(n.max(initial=1)))), _NO_ID)
    inside = place < out.shape[1]
    out[which[order][inside], place[inside]] = ids[order][inside]
    return rows[first], out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query row its k best of vectors: query_id, rank (from 1), vec_id, score. Ties go to the smaller id."""

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(embedding)).alias("v")).dropna()

    v, q = ready(vectors), ready(queries).distinct()
    spark = vectors.sparkSession
    bounded_batches(spark)
    blocks = max(1, math.ceil(q.count() / QUERIES))
    if blocks == 1:
        return _searched(v, q, k)[0]
    out = None
    for i in range(blocks):  # one block of queries is on its way at a time; its results are written before the next is fetched
        found, sent = _searched(v, q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k)
        found = saved(found, "top-k")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _searched(v: DataFrame, block: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The k best of each query of a block, and the broadcast that they need until they are written."""
    queries = sorted((r["vec_id"], r["v"]) for r in block.collect())
    width = max((len(x) for _, x in queries), default=0)
    matrix = np.zeros((len(queries), width), np.int64)
    for i, (_, x) in enumerate(queries):
        matrix[i, : len(x)] = x
    sent = v.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries], np.int64), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        best = Best(ids, vectors, k)
        for b in batches if len(ids) else ():
            all_ids, rows = b.column("vec_id").to_numpy(), _matrix(b.column("v"), best.vectors.shape[1])
            if rows.shape[1] > best.vectors.shape[1]:
                best.vectors = np.pad(best.vectors, ((0, 0), (0, rows.shape[1] - best.vectors.shape[1])))
            for at in range(0, len(rows), ROWS):
                best.search(all_ids[at : at + ROWS], rows[at : at + ROWS])
        which, place = np.nonzero(best.found != _NO_ID)
        columns = (which.astype(np.int64), ids[which], best.found[which, place], best.scores[which, place])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "query_id", "vec_id", "score"])

    found = v.mapInArrow(run, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["q", "rank"])
    return found.select("query_id", "rank", "vec_id", "score"), sent
