"""Toxicity scores: a lexicon trie met by Levenshtein automata, weighed by the context of each hit.

Terms are a fixed seed list and stems and words that labelled rows show to be
far more frequent in toxic documents. They form one trie. A text's word walks
a lazily built deterministic automaton whose states are sets of (trie node,
edits so far): the intersection of the trie with the Levenshtein automaton of
the word, so a misspelled term is found in time of the word's length. A hit
inside quotation marks (read from left to right, in one line, none inside
another) or after a reporting word counts for less, one beside a
second-person word for more. Sums of these weights feed a logistic regression.

The model is fitted on at most MAX_TOXIC + MAX_CLEAN labelled documents, chosen
by a hash of doc_id; terms are learned on one half of them and weighed on the
other, both ways round, so that weights are those of unseen texts. Terms are
counted and features made where the texts lie. What comes to the driver are the
terms that tell the classes apart and N_FEATURES numbers for each of these
documents, for the regression.

Defined cases: null text counts as empty and, as every text without hits, has
the base score; rows with a null doc_id are scored but never learned from or
held out; of repeated labels of a doc_id the highest counts, of repeated texts
of one the least is learned from; without any labelled row of both kinds the
seed list alone scores; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, fresh, saved, trim

MAX_TOXIC, MAX_CLEAN = 4000, 8000
MIN_FUZZY, CACHED_WORDS, CACHED_BYTES, CACHED_STATES = 5, 200_000, 80, 20_000
MIN_SHARE, MIN_ODDS, COUNTED_TERMS = 0.003, 1.5, 500_000
WINDOW, QUOTED, ADDRESSED = 4, 0.3, 1.5

#: Insults that every model starts from.
SEED = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumbass bastard".split()
#: Words that report speech, and words that address a person.
REPORTING = frozenset(b"said says wrote writes quoted quote called sagte schrieb dijo escribi dit crit".split())
ADDRESSING = frozenset(b"you your yourself ur du dein deine dich tu te ton toi usted eres vous votre".split())

#: ASCII letters and digits stay, other ASCII becomes a space, other bytes stay; texts are lower-cased before.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Spaces and punctuation beyond ASCII, which part words too.
_APART = re.compile("[" + "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c))[0] in "ZP") + "]")
#: A quotation ends in its line.
_QUOTES = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“\n]+“")


def words(text: str) -> list[bytes]:
    if not text.isascii():
        text = _APART.sub(" ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _State(dict):
    """A set of (trie node, edits so far): the state that each letter leads to, made when first asked for, and the best (edits, -weight, term) of stems and of whole terms that end here."""

    __slots__ = ("lexicon", "nodes", "other", "stem", "whole")

    def __init__(self, lexicon: Lexicon, nodes: frozenset):
        self.lexicon, self.nodes, self.other = lexicon, nodes, None
        self.stem, self.whole = (
            min(((e, -lexicon.terms[t], t) for n, e in nodes if (t := column[n]) and (not e or lexicon.fuzzy[n])), default=None)
            for column in (lexicon.stem, lexicon.whole)
        )

    def __missing__(self, ch: str) -> _State:
        if ch in self.lexicon.letters:
            to = self[ch] = self.lexicon.move(self.nodes, ch)
            return to
        if self.other is None:  # all letters that no term has lead to one state
            self.other = self.lexicon.move(self.nodes, ch)
        return self.other


class _Known(dict):
    """What each word was found to be."""

    __slots__ = ("look",)

    def __missing__(self, word: bytes) -> tuple[str, int] | None:
        return self.look(word)


class Lexicon:
    """Terms with weights: whole words, and stems ("idio*") that any ending may follow; one edit is free in longer ones."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for term in sorted(terms):
            at = 0
            letters = term.rstrip("*")
            for ch in letters:
                at = self.children[at].setdefault(ch, len(self.children))
                if at == len(self.whole):
                    for column, v in ((self.children, {}), (self.whole, None), (self.stem, None), (self.fuzzy, False)):
                        column.append(v)
            (self.stem if term.endswith("*") else self.whole)[at] = term
            self.fuzzy[at] = len(letters) >= MIN_FUZZY
        self.letters = frozenset(ch for c in self.children for ch in c)
        self.states: dict[frozenset, _State] = {}
        self.start: _State | None = None
        self.known = _Known()
        self.known.look = self.look

    def _state(self, nodes: set[tuple[int, int]]) -> _State:
        """The state of these and of those that one left-out letter reaches."""
        more = {(child, 1) for node, edits in nodes if not edits for child in self.children[node].values()}
        key = frozenset(nodes | {s for s in more if (s[0], 0) not in nodes})
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State(self, key)
        return state

    def _started(self) -> _State:
        self.start = self._state({(0, 0)})
        return self.start

    def move(self, nodes: frozenset, ch: str) -> _State:
        got: set[tuple[int, int]] = set()
        for node, edits in nodes:
            if ch in self.children[node]:
                got.add((self.children[node][ch], edits))
            if not edits:
                got.add((node, 1))
                got.update((child, 1) for c, child in self.children[node].items() if c != ch)
        return self._state({(n, e) for n, e in got if not e or (n, 0) not in got})

    def look(self, word: bytes) -> tuple[str, int] | None:
        """The term that a word is or misspells, with the edits, or None. Fewest edits, then the heaviest term."""
        state = self._started() if self.start is None else self.start
        best = None
        for ch in word.decode("utf-8", "replace"):
            state = state[ch]
            if not state.nodes:
                break
            if state.stem and (best is None or state.stem < best):
                best = state.stem
        if state.whole and (best is None or state.whole < best):
            best = state.whole
        found = best and (best[2], best[0])
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        if len(self.states) >= CACHED_STATES:
            self.forget()
        if len(word) <= CACHED_BYTES:
            self.known[word] = found
        return found

    def forget(self) -> None:
        """Drop all states; they are made again as words need them."""
        for state in self.states.values():
            state.clear()
            state.other = None
        self.states.clear()
        self.start = None

    def features(self, text: str) -> list[float]:
        found = words(text)
        is_term = list(map(self.known.__getitem__, found))
        if not any(is_term):
            return [0.0] * N_FEATURES
        hits = [(i, h) for i, h in enumerate(is_term) if h]
        quoted = _quoted(text, found) if _QUOTES.search(text) else ()
        exact, fuzzy, top, aside = 0.0, 0.0, 0.0, 0.0
        terms = set()
        for i, (term, edits) in hits:
            weight = self.terms[term]
            near = found[max(0, i - WINDOW) : i + WINDOW + 1]
            if any(a <= i < b for a, b in quoted) or not REPORTING.isdisjoint(found[max(0, i - WINDOW) : i]):
                aside += weight
                weight *= QUOTED
            elif not ADDRESSING.isdisjoint(near):
                weight *= ADDRESSED
            if edits:
                fuzzy += weight
            else:
                exact += weight
                terms.add(term)
                top = max(top, weight)
        n = len(found)
        return [math.log1p(exact), math.log1p(fuzzy), top, math.log1p(len(terms)), math.log1p(1000 * exact / n), math.log1p(1000 * fuzzy / n), math.log1p(aside)]


N_FEATURES = 7


def _quoted(text: str, found: list[bytes]) -> list[tuple[int, int]]:
    """Word ranges inside quotation marks."""
    lower = text.lower()
    if len(lower) != len(text):
        text = lower
    starts = [m.start() for m in re.finditer(r"(?:[^\x00-\x7f]|[0-9a-z])+", _APART.sub(" ", lower))]
    return [(bisect.bisect_left(starts, m.start()), bisect.bisect_left(starts, m.end())) for m in _QUOTES.finditer(text)]


def terms_of(text: str) -> set[str]:
    """The words and stems of a text."""
    terms: set[str] = set()
    for w in set(words(text)):
        s = w.decode("utf-8", "replace")
        terms.add(s)
        terms.update(s[:n] + "*" for n in range(4, min(9, len(s) + 1)))
    return terms


def _least(n1: int) -> float:
    """In how many of n1 toxic documents a term must be."""
    return max(3, n1 * MIN_SHARE)


def telling(counts: Iterable[tuple[str, int, int]], n1: int, n0: int, n_often: int) -> dict[str, float]:
    """Log odds of terms, for those that are frequent in toxic documents and rare elsewhere.

    counts: term, toxic and other documents with it, of n1 and n0; n_often: how many terms are frequent in toxic documents.
    """
    n1, n0 = max(1, n1), max(1, n0)
    share = n1 / (n1 + n0)
    # Chernoff's bound on the chance that a term without meaning falls on toxic documents so often, with allowance for the number of terms.
    sure = math.log(max(2, n_often))
    odds = {}
    for t, k, k0 in counts:
        n = k + k0
        p = k / n if n else 0.0
        if k >= _least(n1) and p > share and n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)) >= sure:
            odds[t] = math.log((k + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    odds = {t: v for t, v in odds.items() if v >= MIN_ODDS}

    def told(t: str) -> bool:
        """Whether a shorter stem says as much."""
        letters = t.rstrip("*")
        return any(odds.get(letters[:n] + "*", 0) >= odds[t] - 0.7 for n in range(4, len(letters) + (not t.endswith("*"))))

    return {t: odds[t] for t in sorted(odds) if not told(t)}


def _lexicon(learned: dict[str, float]) -> Lexicon:
    return Lexicon({s: 4.0 for s in SEED} | {t: round(v, 4) for t, v in learned.items()})


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a ridge: mean and scale of the features, and the weights, bias first."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge @ b
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        step = np.linalg.solve(hess, grad)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def _untaught() -> dict:
    return {"terms": {}, "mean": [0.0] * N_FEATURES, "scale": [1.0] * N_FEATURES, "b": [-3.0, 2.0] + [0.0] * (N_FEATURES - 1)}


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of these each term is, by slot; in pieces of bounded size, whose counts add up."""
    seen: Counter = Counter()

    def piece() -> pd.DataFrame:
        out = pd.DataFrame([(t, slot, n) for (t, slot), n in seen.items()], columns=["term", "slot", "n"])
        seen.clear()
        return out

    try:
        for pdf in parts:
            for text, slot in zip(pdf["text"], pdf["slot"], strict=True):
                seen.update((t, slot) for t in terms_of(text))
                if len(seen) >= COUNTED_TERMS:
                    yield piece()
        yield piece()
    finally:
        trim()


def _taught(rows: DataFrame, n: list[int]) -> list[dict[str, float]]:
    """Terms that documents outside of half 0, outside of half 1, and all teach. slot is the half, and 2 more for toxic ones; n counts rows by slot."""
    fits = ((1,), (0,), (0, 1))
    by_slot = [F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)]
    counts = rows.select("text", "slot").mapInPandas(_counted, "term string, slot int, n long").groupBy("term").agg(*by_slot)
    k1 = [sum((F.col(f"n{2 + h}") for h in halves), F.lit(0)) for halves in fits]
    k0 = [sum((F.col(f"n{h}") for h in halves), F.lit(0)) for halves in fits]
    n1 = [sum(n[2 + h] for h in halves) for halves in fits]
    n0 = [sum(n[h] for h in halves) for halves in fits]
    often = [k >= F.lit(float(_least(m))) for k, m in zip(k1, n1, strict=True)]
    # Shorter terms are no lexicon terms. The share of toxic rows alone decides little, the odds leave few terms; telling() decides to the last digit.
    frequent = saved(counts.where((F.length(F.rtrim(F.col("term"), F.lit("*"))) >= 3) & (often[0] | often[1] | often[2])), "toxicity-terms")
    n_often = frequent.agg(*[F.count(F.when(o, 1)).alias(f"f{i}") for i, o in enumerate(often)]).first()
    odds = [F.log((a + 0.5) / (m1 + 1)) - F.log((b + 0.5) / (m0 + 1)) for a, b, m1, m0 in zip(k1, k0, n1, n0, strict=True)]
    near = [o & (v >= MIN_ODDS - 0.01) for o, v in zip(often, odds, strict=True)]
    found = frequent.where(near[0] | near[1] | near[2]).collect()
    return [
        telling([(r["term"], sum(r[f"n{2 + h}"] for h in halves), sum(r[f"n{h}"] for h in halves)) for r in found], n1[i], n0[i], n_often[i])
        for i, halves in enumerate(fits)
    ]


def fit_model(rows: DataFrame, weight: dict[int, float]) -> dict:
    """terms, and mean, scale and b of the regression, from rows of text, y and half (0 or 1). weight undoes the sampling of the classes."""
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("slot", (2 * F.col("y") + F.col("half")).cast("int"))
    n = [0] * 4
    for r in rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["slot"]] = r["n"]
    if not n[0] + n[1] or not n[2] + n[3]:
        return _untaught()
    *others, terms = _taught(rows, n)
    sent = rows.sparkSession.sparkContext.broadcast(others)

    def weighed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons = [_lexicon(t) for t in sent.value]
        with dropped(*(c for x in lexicons for c in (x.known, x.states))):
            for pdf in parts:
                yield pd.DataFrame({"y": pdf["slot"] // 2, "x": [lexicons[s % 2].features(t) for t, s in zip(pdf["text"], pdf["slot"], strict=True)]})

    got = sorted((r["y"], r["x"]) for r in rows.select("text", "slot").mapInPandas(weighed, "y int, x array<double>").collect())
    y = np.array([k for k, _ in got])
    mean, scale, b = _fit(np.array([x for _, x in got]), y, np.where(y == 1, weight[1], weight[0]))
    return {"terms": terms, "mean": mean.tolist(), "scale": scale.tolist(), "b": b.tolist()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model, from labelled rows that are not held out."""
    y = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    y = y.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / max(1, counts.get(k, 0))) for k, most in ((0, MAX_CLEAN), (1, MAX_TOXIC))}
    by_hash = F.xxhash64(F.lit("toxicity"), "doc_id")
    drawn = y.where("y = 1").orderBy(by_hash, "doc_id").limit(MAX_TOXIC).unionByName(y.where("y = 0").orderBy(by_hash, "doc_id").limit(MAX_CLEAN))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # The drawn ids are bounded by the two parameters, so they are sent out and no text is shuffled but theirs.
    rows = d.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.withColumn("half", (F.xxhash64(F.lit("toxicity half"), "doc_id") % 2 != 0).cast("int"))
    # Spread by number, so that adaptive execution does not put these few rows in one task.
    spread = max(2, min(200, docs.sparkSession.sparkContext.defaultParallelism))
    return fit_model(saved(rows.repartition(spread, "doc_id"), "toxicity-rows"), {k: 1 / v for k, v in share.items()})


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1 ("_" is added to its name while that is taken). Rows stay where they are."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _scored(parts, sent.value)

    return docs.withColumn(fresh(docs, name), scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _scored(parts: Iterator[pd.Series], model: dict) -> Iterator[pd.Series]:
    lexicon = _lexicon(model["terms"])
    mean, scale, b = (np.array(model[k]) for k in ("mean", "scale", "b"))
    with dropped(lexicon.known, lexicon.states):
        for s in parts:
            x = np.array([lexicon.features(t) if t else [0.0] * N_FEATURES for t in s]).reshape(-1, N_FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(b[0] + ((x - mean) / scale) @ b[1:], -30, 30))))
