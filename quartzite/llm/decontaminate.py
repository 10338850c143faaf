"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words make one automaton (a state per class of end positions,
restarted for each item). A document's words are streamed through it; after
each word the automaton knows the longest run that ends there and occurs in
some item. Where that run reaches the window (13 words; an item with fewer
words is a window of its own), the window's words are hit and the items that
hold it are noted. The spans of hit words are cut from the text, and a
document of which they cover the limit or more is marked contaminated.

The items are sent to the executors in blocks of at most BLOCK_WORDS words,
so an automaton's size is bounded whatever the benchmark's; with more than one
block, documents pass once for each, and what a pass found is written to the
shared folder before the next.

Words: A-Z lower-cased, then runs of ASCII letters, ASCII digits and non-ASCII
characters. Defined cases: null and empty texts have no words, are not
contaminated and stay as they are; items without words match nothing; items
that repeat an id count once; items with a null id hit words and are not
listed; repeated rows are judged alike; empty tables give empty results or no hits;
other columns are carried, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, fresh, saved

WINDOW, PERCENT, BLOCK_WORDS = 13, 5, 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: ASCII letters in lower case and digits stay, other ASCII becomes a space, other bytes stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over the words of items, marked for windows of `window` words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        runs = []
        for item, text in items:
            run = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if run:
                runs.append((item, run))
                last = 0
                for w in run:
                    last = self._extend(last, w)
        #: At a state: items whose windows end there, by the windows' length.
        self.ends: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, run in runs:
            n = min(window, len(run))
            state = have = 0
            for w in run:
                state, have = self.step(state, have, w)
                if have > n:
                    have = n
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                if have == n:
                    self.ends[state][n].update(() if item is None else (item,))
        self.least = min((n for by in self.ends.values() for n in by), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state({}, -1, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _state(self, nxt: dict[int, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def step(self, state: int, have: int, w: int) -> tuple[int, int]:
        """After word w: the state, and the length of the longest run that ends here."""
        nxt = self.next
        while True:
            to = nxt[state].get(w)
            if to is not None:
                return to, have + 1
            if not state:
                return 0, 0
            state = self.link[state]
            have = self.length[state]

    def match(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, spans of hit words [first, past the last], and the items with occurring windows."""
        found = words(text)
        spans: list[list[int]] = []
        items: set[str] = set()
        if not self.least:
            return len(found), spans, items
        nxt, link, length, least, ends = self.next, self.link, self.length, self.least, self.ends
        state = have = 0
        for at, w in enumerate(map(self.vocabulary.get, found)):
            to = nxt[state].get(w)
            while to is None:
                if not state:
                    break
                state = link[state]
                have = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state = to
            have += 1
            if have >= least:
                reach, s = 0, state
                while s:
                    if s in ends:
                        for n, ids in ends[s].items():
                            if n <= have:
                                reach = max(reach, n)
                                items |= ids
                    s = link[s]
                if reach:
                    first = at + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, at + 1])
        return len(found), spans, items


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """text without the words of the spans and what lies between them."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, done = [], 0
    for first, past in spans:
        out.append(text[done : at[first][0]])
        done = at[past - 1][1]
    return b"".join([*out, text[done:]])


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of at most BLOCK_WORDS words (a longer item alone), one block on the driver at a time."""
    block: list[tuple[str | None, bytes]] = []
    held = 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).dropna(subset=["t"])
    for r in rows.toLocalIterator():
        t = r["t"].encode()
        n = len(words(t))
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r["i"], t))
        held += n
    yield block


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, cutting: bool = False) -> tuple[DataFrame, str, str, str]:
    """The columns keep of docs (all, if None) with the number of words, the hit items and the hit spans; and these columns' names. cutting: text has no hit spans."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_words, found, where = (fresh(docs, c) for c in ("n_words", "hit_items", "hit_spans"))
    keep = docs.columns if keep is None else keep
    d = docs.select(*dict.fromkeys([*keep, text]))
    d = d.withColumn(n_words, F.lit(0).cast("long")).withColumn(found, F.lit(None).cast("array<string>")).withColumn(where, F.lit(None).cast("array<array<int>>"))
    rest = blocks(items, item_id, item_text)
    block: list | None = next(rest)
    while block is not None:
        following = next(rest, None)
        last = following is None
        d = _pass(d, spark.sparkContext.broadcast(block), window, text, (n_words, found, where), [*keep, n_words, found, where] if last else d.columns, cutting and last)
        if not last:
            d = saved(d, "decontaminate")
        block = following
    return d, n_words, found, where


def _pass(d: DataFrame, sent: Broadcast, window: int, text: str, names: tuple[str, str, str], out: list[str], cutting: bool) -> DataFrame:
    """Stream the texts through the automaton of one block of items, and add what it finds."""
    return d.mapInArrow(lambda batches: _streamed(batches, sent, window, text, names, out, cutting), d.select(*out).schema)


def _streamed(batches: Iterator[pa.RecordBatch], sent: Broadcast, window: int, text: str, names: tuple[str, str, str], out: list[str], cutting: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
    with dropped():
        automaton = Automaton(sent.value, window)
        for b in batches:
            counts = []
            items, spans = (b.column(c).to_pylist() for c in names[1:])
            texts = b.column(text).cast(pa.binary())
            for i, t in enumerate(texts):
                n, new, hit = automaton.match(t.as_py() or b"")
                counts.append(n)
                items[i] = sorted(hit.union(items[i] or ()))
                spans[i] = _merged(new, spans[i] or [])
            columns = {c: pa.array(v, k) for c, v, k in zip(names, (counts, items, spans), kinds, strict=True)}
            if cutting and any(spans):
                columns[text] = pa.array([cut(t, s).decode() if s else t and t.decode() for t, s in zip(texts.to_pylist(), spans, strict=True)], b.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else b.column(c) for c in out], names=out)


def judged(n_words: str, where: str, percent: int = PERCENT) -> tuple[Column, Column]:
    """Number of hit words, and whether they are so many percent of all words or more, in whole numbers."""
    n_hit = F.aggregate(where, F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    return n_hit, (n_hit > 0) & (100 * n_hit >= percent * F.col(n_words))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = PERCENT, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with hit spans cut from text, and five columns (with "_" added where the name is taken).

    n_words, n_hit: words of the whole text, and those inside hit spans;
    hit_items: ids of the items with occurring windows, sorted as strings;
    hit_spans: [first, past the last] word of each span;
    contaminated: n_hit is percent of n_words or more, and not 0.
    """
    d, n_words, found, where = hits(docs, items, window, text, item_id, item_text, cutting=True)
    n_hit, bad = judged(n_words, where, percent)
    return d.select(*docs.columns, n_words, n_hit.alias(fresh(docs, "n_hit")), found, where, bad.alias(fresh(docs, "contaminated")))


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    if not a or not b:
        return a or b
    out: list[list[int]] = []
    for first, past in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return out
