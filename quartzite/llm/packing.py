"""Packing by concatenate and cut: two passes with prefix sums over partition totals.

Pass 1 tokenizes every partition, numbers its tokens from 0 and writes the ids
with (partition, start) to the shared folder, so the order of the one long
token stream is fixed on disk and survives lost executors. The totals of the
partitions (one number each; the only thing that reaches the driver) are
summed up to the offset of each partition in the stream. Pass 2 cuts each
document where the fixed windows of the stream end and returns the pieces, a
boundary record each: where it starts in its document, its length, its window
and its place there. No rows are shuffled. All windows but the last are full;
sequences() pads that one.

If the tokenizer drops white space, lower-cases and splits as _PIECE does, ids
are looked up in caches of bounded size: a text's ids are those of its
space-separated chunks in order, and a chunk's are those of its pieces. Where
chunks hold characters beyond plain Latin ones, and for all other tokenizers,
the whole tokenizer reads the text.

Defined cases: null text is an empty text, whose only id is the end id; a
null doc_id stays null; repeated rows are packed as often as they occur;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, bounded_batches, saved

WINDOW, END_ID = 4096, 2
CACHED_BYTES, CACHED_PIECES, CHUNK_BYTES, AT_ONCE, GROUP_BYTES = 128 << 20, 100_000, 150, 2048, 4 << 20

#: Chunks of these characters alone fall apart and change case as _PIECE and str.lower say; all others go to the whole tokenizer.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u017F]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u017F]+")


def _parted(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text between ASCII white space, in fewer different ones of the same ids: lower case, and a comma
    or full stop after a letter as a chunk of its own, which it is in any case. Texts with special tokens are only split, as are
    those where a mark follows a capital: letters are composed before they become small, and few small ones compose alike."""
    parted = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([,.])([ \\n])", r"\1 \2\3")
    odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"[A-Z]\p{M}"))
    return pc.ascii_split_whitespace(pc.if_else(odd, texts, parted))


class _Places(dict):
    """Chunks by the order in which they were first met."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self.new.append(chunk)
        place = self[chunk] = len(self)
        return place


class Encoder:
    """Ids of byte texts by a tokenizers file; pieces: whether chunks between spaces, and the pieces that these fall into, may be read one by one."""

    def __init__(self, path: str, pieces: bool):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merger = None
        if pieces:
            self.merger = Tokenizer.from_file(path)
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.signs = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}
        self.pieces: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.places = _Places()
        self.flat = np.empty(1 << 16, np.uint32)
        self.end = self.held = 0
        #: By place: where its ids start in flat, and their number.
        self.first = self.number = np.zeros(0, np.int64)

    def _merged(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of pieces, which hold no white space and are normalised, and the number of each piece's, part by part."""
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            signs = [p if p.isascii() else "".join(map(self.signs.__getitem__, p.encode())) for p in part]
            e = self.merger.encode(signs, is_pretokenized=True, add_special_tokens=False)
            yield np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))

    def _hold(self, at: np.ndarray, ids: np.ndarray, number: np.ndarray) -> None:
        """Keep the ids of the chunks at these places."""
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.end : self.end + len(ids)] = ids
        self.first[at] = self.end + np.cumsum(number) - number
        self.number[at] = number
        self.end += len(ids)

    def _learn(self, chunks: list[bytes]) -> None:
        """Learn the chunks that have the latest places."""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        self.held += sum(map(len, chunks)) + CHUNK_BYTES * len(chunks)  # what Python and the arrays need for each
        before = len(self.first)
        self.first, self.number = (np.concatenate([x, np.zeros(len(chunks), np.int64)]) for x in (self.first, self.number))
        # A chunk of lower-case ASCII letters is one piece, and as a chunk it is known from now on.
        alone = [i for i, c in enumerate(chunks) if c.isalpha() and c.islower()]
        done = 0
        for ids, number in self._merged([chunks[i].decode() for i in alone]):
            self._hold(before + np.array(alone[done : done + len(number)], np.int64), ids, number)
            done += len(number)
        rest = sorted(set(range(len(chunks))).difference(alone))
        texts = [chunks[i].decode("utf-8", "replace") for i in rest]
        split = [_PIECE.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        pieces = self.pieces
        new = list({p for s in split if s for p in s if p not in pieces})
        done = 0
        for ids, number in self._merged(new):
            ends = np.cumsum(number).tolist()
            ids = ids.tolist()
            pieces.update(zip(new[done : done + len(number)], (ids[a:b] for a, b in pairwise([0, *ends])), strict=True))
            done += len(number)
        odd = [t for t, s in zip(texts, split, strict=True) if s is None]
        others = (e.ids for i in range(0, len(odd), 1024) for e in self.whole.encode_batch(odd[i : i + 1024], add_special_tokens=False))
        got = [next(others) if s is None else [i for p in s for i in pieces[p]] for s in split]
        self._hold(before + np.array(rest, np.int64), np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls, end id last."""
        if not self.merger:
            whole = self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array([*e.ids, END_ID], np.uint32) for e in whole]
        if self.held > CACHED_BYTES:
            self._clear()
        places = self.places
        parted = _parted(texts)
        words = parted.flatten().cast(pa.binary()).dictionary_encode()
        chunks = words.dictionary.to_pylist()
        place = np.fromiter(map(places.__getitem__, chunks), np.int64, len(chunks))
        new, places.new = places.new, []
        if new:
            self._learn(new)
        at = place[words.indices.to_numpy()]
        first, n = self.first[at], self.number[at]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(first - before, n) + np.arange(int(n.sum()))]
        ends = np.append(before, len(ids))[parted.offsets.to_numpy()[1:] - parted.offsets[0].as_py()].tolist()
        out, done = [], 0
        for end in ends:
            out.append(np.append(ids[done:end], np.uint32(END_ID)))
            done = end
        return out


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a few texts at a time: AT_ONCE of them, or GROUP_BYTES."""
    first = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if i + 1 - first == AT_ONCE or held > GROUP_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


_encoder = Kept()


def id_type(tokenizer: str) -> str:
    """The narrowest type that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


#: The pre-tokenizer pattern that _PIECE restates for plain characters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_in_pieces(tokenizer: str) -> bool:
    """Whether the file lower-cases and splits as _PIECE does, so that pieces may be merged one by one."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
    return kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and pattern == _PATTERN


def _numbered(batches: Iterator[pa.RecordBatch], tokenizer: str, by_piece: bool, dtype: str) -> Iterator[pa.RecordBatch]:
    """The rows of tokenized() for one partition."""
    part, at = TaskContext.get().partitionId(), 0
    with _encoder.use(tokenizer, lambda: Encoder(tokenizer, by_piece)) as encoder:
        for b in batches:
            for low, high in _groups(b.column("text")):
                ids = encoder.ids(b.column("text").slice(low, high - low))
                n = [len(x) for x in ids]
                start = [at, *accumulate(n, initial=at)][1:-1]
                at += sum(n)
                columns = {
                    "doc_id": b.column("doc_id").slice(low, high - low),
                    "part": pa.array([part] * len(n), pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "ids": pa.array([x.astype(dtype).tobytes() for x in ids], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, part, start (its place among part's tokens), n, ids (binary, of id_type)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind, dtype, by_piece = d.schema["doc_id"].dataType.simpleString(), id_type(tokenizer), splits_in_pieces(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(batches, tokenizer, by_piece, dtype)

    bounded_batches(docs.sparkSession)
    return d.mapInArrow(run, f"doc_id {kind}, part int, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    dtype = id_type(tokenizer)
    t = tokenized(docs, tokenizer, doc_id, text)
    kind = t.schema["doc_id"].dataType.simpleString()
    t = saved(t, "packing")
    totals = sorted((r["part"], r["n"]) for r in t.groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets = docs.sparkSession.sparkContext.broadcast(dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = offsets.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            source = []
            rows = zip(*(b.column(c).to_pylist() for c in ("part", "start", "n", "ids")), strict=True)
            for row, (part, start, n, low) in enumerate(rows):
                ids = np.frombuffer(low, dtype).astype("<u4")
                at = offset[part] + start
                done = 0
                while done < n:
                    seq, place = divmod(at + done, window)
                    length = min(window - place, n - done)
                    source.append(row)
                    for column, v in zip(out, (done, length, ids[done : done + length].tobytes(), n, seq, place), strict=True):
                        column.append(v)
                    done += length
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [b.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return t.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, ids (binary, padded to the window). A sequence has at most window pieces."""
    g = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.lit(pad_id.to_bytes(4, "little") * window)
    return g.select("sequence_id", n.alias("n_tokens"), F.substring(F.concat(ids, pad), 1, 4 * window).alias("ids"))

