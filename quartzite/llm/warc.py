"""WARC archives in seekable Zstandard bundles.

Each task writes its records to bundles: records are grouped into frames of
about FRAME_BYTES, each compressed on its own, and a bundle ends with the seek
table of the Zstandard seekable format (a skippable frame of compressed and
decompressed frame sizes). The index that comes back maps a record id to its
bundle, its frame and its offset in the frame, so one record is read with two
seeks and one frame. Of records with equal payloads of REVISIT_BYTES or more,
that with the smallest page id holds the payload; the others are revisit
records that refer to it. Duplicates are found by a partial aggregate over
digests, and the join back to the pages is an equi join that Spark may split.

A bundle begins with a warcinfo record. Records have identifiers of their own, but for rows that repeat both
page_id and payload, where revisits refer to any of them. Reading back verifies digests: a response's payload against its head,
and a revisit's head against the payload, read again, of the record that it names.

A bundle's name holds an identifier of the attempt that wrote it and the index
names the bundles of the attempt that Spark committed, so a lost executor or a
second attempt leaves at most a file that no index names.

Defined cases: null payloads are empty, null urls are empty; rows that repeat
the smallest page_id of a payload are all responses; a null page_id is a
revisit of the smallest other, and all are responses if there is none; an empty
table writes no bundle; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cleaned, saved, shared_dir

REVISIT_BYTES, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 100, 1 << 18, 1 << 25, 3
#: Fixed values of the seekable format: magic of skippable frame 14, and of the seek table's end.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class BundleWriter:
    """One bundle: add records, then close."""

    def __init__(self, uri: str):
        import zstandard

        self.uri = uri
        where, path = _filesystem(uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = where.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self._end_frame()
        place = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle through its seek table."""

    def __init__(self, uri: str):
        where, path = _filesystem(uri)
        self.file = where.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 128 else 8
        table = self.file.read_at(n * width, end - 9 - n * width)
        self.at, self.sizes, start = [], [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.at.append((start, packed))
            self.sizes.append(plain)
            start += packed
        self.last: tuple[int, bytes] | None = None

    def frame(self, i: int) -> bytes:
        import zstandard

        if self.last is None or self.last[0] != i:
            start, packed = self.at[i]
            plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=self.sizes[i])
            self.last = (i, plain)
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def make_info(date: str) -> bytes:
    """The warcinfo record of a bundle."""
    block = b"software: quartzite\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def make_record(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or with refers_to a revisit record that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, head if refers_to else head + payload)


def read_record(record: bytes) -> dict:
    """Fields of the WARC head and of the HTTP head (prefixed "http."), and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields |= {f"http.{k}": v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return fields | {"payload": payload}


def _record_id(page_id, mark: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{mark}"


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write bundles to folder (a new one in the shared folder, gone when the application ends, if None), dated date (now, if None).

    The index: page_id, record_id, refers_to (a record_id, for revisits), bundle, frame, offset, length.
    """
    bounded_batches(pages.sparkSession)
    folder = folder or cleaned(pages.sparkSession, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    p = p.withColumn("digest", F.sha2("payload", 256))
    same = p.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = saved(same.where("n > 1").select("digest", "first"), "warc-same")  # a plain table, so that Spark may split the join
    p = p.join(same, "digest", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("first"), (F.col("first").isNotNull() & ~again).alias("named"))
    kind = p.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, bundle, n = uuid.uuid4().hex, None, 0
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                pid, address, payload, digest, first, named = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "first", "named"))
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{attempt}-{n:05d}.warc.zst")
                    bundle.add(make_info(date))
                    n += 1
                rid = _record_id(pid, digest if named else uuid.uuid4().hex)
                refers_to = None if first is None else _record_id(first, digest)
                record = make_record(rid, address, payload, digest, refers_to, date)
                rows.append((rid, refers_to, bundle.uri, *bundle.add(record), len(record)))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *columns], names=["page_id", "record_id", "refers_to", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = p.mapInArrow(run, f"page_id {kind}, record_id string, refers_to string, bundle string, frame int, offset long, length long")
    return saved(index, "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, read from their bundles: page_id, record_type, refers_to (a page_id), payload, payload_bytes, payload_digest, verified.

    A revisit has no payload of its own; its size and digest are those of the record that it names, which is read for
    them. verified: heads agree with these.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    responses = _read(index.where("refers_to IS NULL"), kind).select("page_id", "record_type", F.lit(None).cast(kind).alias("refers_to"), "payload", "payload_bytes", "payload_digest", "verified")
    revisits = index.where("refers_to IS NOT NULL")
    named = saved(revisits.select(F.col("refers_to").alias("named")).distinct(), "warc-named")
    named = index.join(named, index["record_id"] == named["named"], "left_semi").dropDuplicates(["record_id"])
    named = saved(_read(named, kind).select(F.col("record_id").alias("named"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest")), "warc-named")
    r = _read(revisits, kind)
    r = r.join(named, r["refers_to"] == named["named"], "left")
    first = F.regexp_replace(F.regexp_replace("refers_to", "^urn:page:", ""), ":[^:]*$", "")
    agrees = F.coalesce((F.col("n") == F.col("payload_bytes")) & (F.col("digest") == F.col("payload_digest")), F.lit(False))
    revisits = r.select("page_id", "record_type", first.cast(kind).alias("refers_to"), "payload", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), agrees.alias("verified"))
    return responses.unionByName(revisits)


def _read(index: DataFrame, kind: str) -> DataFrame:
    """Records with what their heads state (revisits) or their payloads give (responses), and whether the two agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                uri, frame, offset, length = (b.column(c)[i].as_py() for c in ("bundle", "frame", "offset", "length"))
                if reader is None or reader[0] != uri:
                    reader = (uri, BundleReader(uri))
                r = read_record(reader[1].record(frame, offset, length))
                stated = r["WARC-Payload-Digest"].removeprefix("sha256:")
                if r["WARC-Type"] == "revisit":
                    out.append((r["WARC-Record-ID"].strip("<>"), "revisit", r["WARC-Refers-To"].strip("<>"), None, int(r["http.Content-Length"]), stated, True))
                else:
                    digest = hashlib.sha256(r["payload"]).hexdigest()
                    out.append((r["WARC-Record-ID"].strip("<>"), "response", None, r["payload"], len(r["payload"]), digest, digest == stated))
            if out:
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *columns], names=["page_id", "record_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "verified"])

    return index.mapInArrow(run, f"page_id {kind}, record_id string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, verified boolean")
