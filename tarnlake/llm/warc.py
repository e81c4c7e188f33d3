"""WARC writing, and a normaliser for archives compressed as one gzip stream.

Archives travel as rows of a table (name, data), so they live in any store that Spark can write. The writer makes
monolithic gzip streams; the normaliser inflates each stream once, slice by slice, and rewrites every record as a member of
its own. The sidecar index is a table of its own with a row (archive, part, record, offset, length) for each record, which
is read without the data; the reader fetches records through it, all of them or those asked for. Memory is bounded by an
archive part and one record.

Defined results: a null payload is empty, a null address is urn:none. Of records with equal payloads of at least
min_bytes, those with the largest id are responses, so repeated rows of that id are all responses, and rows whose id is
null revisit the largest id there is. If all ids of a group are null, all are responses. An empty table gives no
archives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, store, with_columns

GZIP = 31
SLICE = 1 << 20
#: Uncompressed bytes after which a writer begins the next archive, and compressed bytes of one normalised part.
ARCHIVE, PART = 16 << 20, 8 << 20
#: Rows of about 60 bytes of the tables of repeated payloads and of records that may be broadcast, and tasks that a frequent
#: payload of a larger table is dealt to.
BROADCAST_ROWS, SALTS = 100_000, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def key_of(urn: str | None) -> int | None:
    found = (urn or "")[10:-1]
    return int(found) if found and found != "null" else None


def serialise(key: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record, not compressed. A revisit has the response's headers but no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=URI_SAFE) if url else 'urn:none'}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URI_SAFE = "!#$%&'()*+,/:;=?@[]~"


def inflate(data: bytes) -> Iterator[bytes]:
    """The plain bytes of all gzip members in data, slice by slice."""
    at, unpack = 0, zlib.decompressobj(GZIP)
    held = b""
    while at < len(data) or held:
        if not held:
            held = data[at : at + SLICE]
            at += SLICE
        if got := unpack.decompress(held, SLICE):
            yield got
        held = unpack.unconsumed_tail
        if unpack.eof:
            held = unpack.unused_data
            unpack = zlib.decompressobj(GZIP)
            if not held and at >= len(data):
                return
    if tail := unpack.flush():
        yield tail
    if not unpack.eof:
        raise ValueError("a gzip stream ends early")


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(plain: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record in a stream of slices."""
    held = bytearray()
    source = iter(plain)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record's headers end early")
            at = held.find(b"\r\n\r\n")
        headers = parse_headers(bytes(held[:at]))
        size = at + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record's block ends early")
        yield headers, bytes(held[:size])
        del held[:size]


def member(plain: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return pack.compress(plain) + pack.flush()


def normalise(data: bytes, level: int = 6, part: int = PART) -> Iterator[tuple[bytes, list[tuple[str, int, int]]]]:
    """Parts of the archive with a gzip member for each record, and of each part the index: (record id, offset, length)."""
    out, index = bytearray(), []
    for headers, record in split_records(inflate(data)):
        packed = member(record, level)
        index.append((headers["warc-record-id"], len(out), len(packed)))
        out += packed
        if len(out) >= part:
            yield bytes(out), index
            out, index = bytearray(), []
    if index:
        yield bytes(out), index


def fetch(data: bytes, offset: int, length: int) -> Record:
    """The record whose member lies at offset."""
    (headers, record), *more = split_records([zlib.decompress(data[offset : offset + length], GZIP)])
    if more:
        raise ValueError("a member holds more than one record")
    return Record(headers, record[record.index(b"\r\n\r\n") + 4 : -4])


def with_references(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """pages with refers_to: the id of the response that a row revisits, or null. Payload digests are grouped with partial aggregation, so a payload of many rows is one row a task; only repeated digests are joined back."""
    pages = pages.withColumn(payload, F.coalesce(F.col(payload), F.lit(""))).withColumn("sha", F.sha1(payload))
    repeated = pages.where(F.octet_length(payload) >= min_bytes).groupBy("sha").agg(F.max(key).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "kept")
    repeated = store(repeated, "warc-repeated")
    older = F.col("kept").isNotNull() & (F.octet_length(payload) >= min_bytes) & (F.col(key).isNull() | (F.col(key) < F.col("kept")))
    if repeated.count() <= BROADCAST_ROWS:
        found = pages.join(F.broadcast(repeated), "sha", "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = pages.withColumn("salt", F.pmod(F.xxhash64(key, "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left").drop("salt")
    return found.withColumn("refers_to", F.when(older, F.col("kept"))).drop("sha", "kept")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Monolithic archives of all pages: (archive, data)."""
    pages = with_columns(pages, **{key: "bigint", url: "string", payload: "string"}).select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    rows = with_references(pages, "page_id", "html", min_bytes).select("page_id", "url", "html", "refers_to")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = TaskContext.get().partitionId(), 0
        pack, out, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), bytearray(), 0

        def archive() -> pa.RecordBatch:
            out.extend(pack.flush())
            return pa.RecordBatch.from_pydict({"archive": [f"{at:06d}-{n:06d}"], "data": [bytes(out)]}, ARCHIVES)

        for b in parts:
            for k, u, h, r in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                plain = serialise(k.as_py(), u.as_py(), (h.as_py() or "").encode(), r.as_py(), date)
                out += pack.compress(plain)
                size += len(plain)
                if size >= ARCHIVE:
                    yield archive()
                    pack, out, size, n = zlib.compressobj(level, zlib.DEFLATED, GZIP), bytearray(), 0, n + 1
        if size:
            yield archive()

    return rows.mapInArrow(run, "archive string, data binary")


ARCHIVES = pa.schema([("archive", pa.string()), ("data", pa.binary())])
NORMAL = pa.schema([("archive", pa.string()), ("part", pa.int32()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])


def normalise_archives(archives: DataFrame, level: int = 6) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (archive, part, data) of archives whose every record is a gzip member, and the sidecar (archive, part, record, offset, length). Each stream is inflated once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for name, data in zip(b.column("archive"), b.column("data"), strict=True):
                for k, (out, index) in enumerate(normalise(data.as_py(), level)):
                    yield pa.RecordBatch.from_pydict({"archive": [name.as_py()], "part": [k], "data": [out], "index": [[dict(zip(("record", "offset", "length"), x, strict=True)) for x in index]]}, NORMAL)

    normal = store(archives.select("archive", "data").mapInArrow(run, "archive string, part int, data binary, index array<struct<record:string,offset:bigint,length:bigint>>"), "warc-normal", "uncompressed")
    sidecar = store(normal.select("archive", "part", F.explode("index").alias("at")).select("archive", "part", "at.*"), "warc-sidecar")
    return normal.select("archive", "part", "data"), sidecar


def read_archive_files(spark, path: str) -> DataFrame:
    """Archives from .warc.gz files, through Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def read(data: DataFrame, sidecar: DataFrame) -> DataFrame:
    """A row for each record of the sidecar, or of a part of it, fetched by its offset: (page_id, payload_bytes, payload_digest, record_type, refers_to, payload); a revisit's payload is null."""
    few = sidecar.count() <= BROADCAST_ROWS
    index = sidecar.groupBy("archive", "part").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "record"))).alias("index"))
    joined = data.join(F.broadcast(index) if few else index, ["archive", "part"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for data, index in zip(b.column("data"), b.column("index"), strict=True):
                raw = data.as_py()
                rows = []
                for x in index.as_py():
                    r = fetch(raw, x["offset"], x["length"])
                    head, _, body = r.block.partition(b"\r\n\r\n")
                    size = int(head.lower().rpartition(b"content-length:")[2])
                    said = r.headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = r.headers["warc-type"]
                    if r.headers["warc-record-id"] != x["record"] or kind == "response" and (len(body) != size or digest(body) != said):
                        raise ValueError(f"record {x['record']} differs from its index or digest")
                    rows.append((key_of(x["record"]), size, said, kind, key_of(r.headers.get("warc-refers-to")), body.decode() if kind == "response" else None))
                    if len(rows) == 500:
                        yield table_of(rows)
                        rows = []
                if rows:
                    yield table_of(rows)

    return joined.select("data", "index").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORDS.types, strict=True)], schema=RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, normalises the archives and reads them back."""
    mono = store(write(pages, min_bytes=min_bytes), "warc-mono", "uncompressed")
    data, sidecar = normalise_archives(mono)
    discard(mono)
    return read(data, sidecar)
