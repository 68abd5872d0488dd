"""Operator 13: web archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends in
the seek table of the public seekable format (a skippable frame with each
frame's compressed and plain size). The index names each record's bundle, frame
and offset inside the frame, so any record is read by decompressing one frame.

Equal payloads are found by their digests alone, before any page is moved; only
their list meets the pages (broadcast up to ``BROADCAST_ROWS``, else by shuffle),
and each task writes its own pages where they are read. A task's bundles carry
its attempt in their names, and its index rows count only once it has ended: a
lost or repeated task leaves files that nothing names, never wrong ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import stored, trimmed

#: Plain bytes that fill a frame, and compressed bytes that fill a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Groups of equal payloads up to which their list is broadcast.
BROADCAST_ROWS = 200_000
#: Compressed bytes that one reading task takes on.
READ_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, offset long, length long, frame_bytes long"
RECORDS = "record_id string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder's URI or plain path."""
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    folder = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", folder))
    return pyarrow.fs.FileSystem.from_uri(folder)


class Bundle:
    """Writes one bundle: records into frames, then the seek table."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, level: int) -> None:
        self.out, self.compressor = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.buffer, self.sizes, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """frame and offset inside it."""
        place = len(self.sizes), len(self.buffer)
        self.buffer += record
        return place

    def flush(self) -> int:
        """Ends the frame; its compressed size."""
        frame = self.compressor.compress(bytes(self.buffer))
        self.out.write(frame)
        self.sizes.append((len(frame), len(self.buffer)))
        self.written += len(frame)
        self.buffer.clear()
        return len(frame)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """Each frame's start and compressed size, from the end of the bundle."""
    end = file.size()
    n, kind, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle ends without a seek table")
    width = 12 if kind & 128 else 8  # with checksums of the frames
    table = file.read_at(n * width, end - 9 - n * width)
    starts, at = [], 0
    for i in range(n):
        (size,) = struct.unpack_from("<I", table, i * width)
        starts.append((at, size))
        at += size
    return starts


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes | None  # None: a revisit
    sha1: str  # hex
    size: int
    refers_to_id: str | None


def record_name(page_id: str, url: str, sha256: str):
    """The identifier of the page's first record with a payload; other records of the same page add to it."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", F.col(url), F.col(sha256)).cast("binary"), 256), 1, 16))


def record(page: Page, record_id: str, date: str = DATE) -> bytes:
    """A response record, or a revisit one whose block ends after the HTTP header."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.size}\r\n\r\n".encode() + (page.payload or b"")
    head = {
        "WARC-Type": "response" if page.refers_to_id is None else "revisit",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(page.sha1)).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if page.url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page.url)
    if page.refers_to_id is not None:
        head |= {"WARC-Refers-To": f"<{page.refers_to_id}>", "WARC-Profile": REVISIT_PROFILE}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def _page_of(record_id: str) -> int | None:
    part = record_id.split(":")[2]
    return int(part) if part else None


def parsed(raw: bytes) -> tuple:
    """A record's columns (``RECORDS``). Raises where its length or a payload's digest is wrong."""
    head, body = raw.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or body[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, payload = body[:size].split(b"\r\n\r\n", 1)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    claimed = int(re.search(rb"(?m)^Content-Length: (\d+)\r?$", http)[1])
    if kind == "response" and (len(payload) != claimed or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    own, refers = fields["WARC-Record-ID"].strip("<>"), fields.get("WARC-Refers-To", "").strip("<>") or None
    return own, _page_of(own), kind, fields.get("WARC-Target-URI"), digest, claimed, refers, _page_of(refers) if refers else None, payload if kind == "response" else None


def _planned(pages: DataFrame, least: int) -> DataFrame:
    """One row a record: page_id, url, payload (null for revisits), sha1, size, own (its identifier if it is the page's first), refers_to_id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("size") >= least)
    each = large.groupBy("sha256", "page_id", "url").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("url").isNull().alias("no_url"), F.col("url"), F.col("copies"))
    equal = stored(each.groupBy("sha256").agg(F.sum("copies").alias("n"), F.min(first).alias("first")).where("n > 1"), "equal-payloads")
    equal = equal.select("sha256", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.copies").alias("copies"))
    few = equal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(equal) if few else equal, "sha256", "left").withColumn("sha1", F.sha1("payload"))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    name, of_first = record_name("page_id", "url", "sha256"), record_name("first_id", "first_url", "sha256")
    own = F.when((F.col("size") >= least) & (F.col("copies").isNull() | is_first), name)
    again = F.col("copies").isNotNull() & ~is_first
    columns = ["page_id", "url", "payload", "sha1", "size", "own", "refers_to_id"]

    def out(df: DataFrame, revisits) -> DataFrame:
        return df.withColumns({"own": own, "refers_to_id": F.when(revisits, of_first), "payload": F.when(~revisits, F.col("payload"))}).select(columns)

    plan = out(joined.where(F.col("copies").isNull() | (F.col("copies") == 1) | ~is_first), again)
    if equal.where("copies > 1").isEmpty():
        return plan
    # Pages that come several times, identifier and address included: one of them is the response.
    same = joined.where(is_first & (F.col("copies") > 1)).groupBy("page_id", "url", "sha256", "sha1", "size", "first_id", "first_url", "copies").agg(F.first("payload").alias("payload"))
    others = same.withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    others = out(others, F.lit(True)).withColumn("own", F.lit(None).cast("string"))
    return plan.unionByName(out(same, F.lit(False))).unionByName(others)


def write(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Writes every page as a record into bundles below folder, which all executors must reach; gives the index, one row a record.

    pages: page_id long, url, html string; other columns are ignored. A null html
    is an empty payload. Of payloads of at least ``least`` bytes that are equal,
    the page with the smallest page_id (nulls last, then by url, nulls last) is a
    response and all others revisit it; of pages that repeat in all columns one is
    the response. A null url gives no target; spaces and control signs in one are
    percent-encoded. An empty table gives an empty index and no bundle.
    """

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        mine = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else "00000-0"
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        bundle, name, n, ordinal = None, "", 0, 0
        waiting: list[tuple] = []  # records of the open frame

        def framed() -> pa.RecordBatch:
            size = bundle.flush()
            out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*(w + (size,) for w in waiting), strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
            waiting.clear()
            return out

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, sha1, size, own, refers = (v.as_py() for v in row)
                ordinal += 1
                record_id = own or f"urn:page:{'' if page_id is None else page_id}:{mine}:{ordinal}"
                raw = record(Page(page_id, url, payload, sha1, size, refers), record_id)
                if bundle is None:
                    name = f"{folder}/pages-{mine}-{n}.warc.zst"
                    bundle, n = Bundle(fs, f"{root}/pages-{mine}-{n}.warc.zst", level), n + 1
                frame, offset = bundle.add(raw)
                waiting.append((record_id, name, frame, offset, len(raw)))
                if len(bundle.buffer) >= frame_bytes:
                    yield framed()
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if bundle:
            if waiting:
                yield framed()
            bundle.close()

    return stored(_planned(pages, least).mapInArrow(task, INDEX), "archive-index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index names (``RECORDS``), each frame decompressed once; every payload is held against its digest.

    payloads: whether they are returned; else the column is null.

    index: rows of ``write``'s index, all or some, e.g. joined with wanted
    identifiers. Frames are dealt out by hash; each is found through its bundle's
    seek table. Revisits carry the size and digest of the full payload, and the
    page_id of the record they refer to. An empty index gives no rows.
    """
    spark = index.sparkSession
    size = index.select("bundle", "frame", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = starts = at = plain = None
        done, held = [], 0
        for batch in batches:
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    if file:
                        file.close()
                    fs, path = filesystem(bundle)
                    name, file, at = bundle, fs.open_input_file(path), None
                    starts = seek_table(file)
                if frame != at:
                    start, size = starts[frame]
                    at, plain = frame, zstandard.ZstdDecompressor().decompress(file.read_at(size, start))
                found = parsed(plain[offset : offset + length])
                done.append(found if payloads else found[:-1] + (None,))
                held += length if payloads else 200
                if held >= 8 << 20:
                    yield _batch(done)
                    done, held = [], 0
        if file:
            file.close()
        if done:
            yield _batch(done)

    places = index.select("bundle", "frame", "offset", "length")
    return places.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(task, RECORDS)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in RECORDS.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])
