"""Operator 6: WARC archives, and the normaliser of archives that are one gzip stream.

`write_archives` writes the records of each task as one monolithic archive: Spark's text sink compresses the file as a single stream. The
normaliser (`normalise`) reads such archives as Spark reads any .gz text: a file is inflated once, from front to end, by one task, and arrives in
lines, so an archive of any size takes the memory of its largest record. Records are put together from the lines by their
lengths, each is compressed as a member of its own, and members fill volumes of about VOLUME_BYTES of records with a sidecar index of
offsets. `read_records` reads records through the index, member by member. Volumes are files of the shared
folder, one in each folder `archive=...`: the text sink writes the bytes of one row, and an empty gzip member as line end, so the
files are valid gzip on any store that Spark can write to.

Of equal payloads (by SHA-1 and length) the one with the smallest page_id is the response, the
others are revisit records without a payload. The equal payloads of one digest may be many: digests
are counted with partial sums, and only those that occur twice or more are joined back, salted.

Defined results: null html is an empty payload, and empty payloads are equal; rows that repeat the
smallest page_id are responses too; a null page_id is larger than all others, and refers to the
smallest if there is one; a null url becomes urn:page:<id>; line ends in a url become spaces; other
columns are left out; an empty table gives no records and no rows. An archive that is cut off, or holds something
else between its records, fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces, written

VOLUME_BYTES, SALTS, LEVEL = 8 << 20, 64, 6
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member that holds nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_ROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_GZIP = 31


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), first (the response's page_id, null if the row is alone)."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "utf-8").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.length("html"))
    twice = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "size", "first")
    twice = written(twice, "warc-repeats").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(twice, ["sha", "size", "salt"], "left").select("page_id", "url", "html", "first")


def record(page_id, url, payload: bytes, first) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    target = " ".join(url.split()) if url else f"urn:page:{page_id}"
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page-Id: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream that comes in parts; archives may follow each other."""
    held, need = bytearray(), None
    for part in stream:
        held += part
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(held[at:end])
                sizes = [x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                if not head.startswith(b"WARC/") or not sizes:
                    raise ValueError("an archive holds something else between its records")
                need = end + 4 - at + int(sizes[0].partition(b":")[2]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, None
        del held[:at]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def lines_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of lines that were split at line feeds."""
    for batch in batches:
        if n := batch.num_rows:
            yield pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("line")), b"\n")[0].as_py() + b"\n"


def deflated(data: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
    return made.compress(data) + made.flush()


def _to_files(rows: DataFrame, path: str) -> None:
    """Writes rows (archive, value): one file each."""
    rows.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "/archive=([^/]+)/", 1).alias("archive"), "content")


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of one gzip stream each, of the records of all pages: one for each task that has any."""
    schema = pa.schema([("value", pa.string())])

    def run(batches):
        for batch in pieces(batches, "html"):
            rows = zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first")), strict=True)
            yield batch_of(schema, value=pa.array([record(*row)[:-1] for row in rows], pa.binary()).cast(pa.string()))  # the sink ends it with a line feed

    record_types(pages).mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


def normalise(spark: SparkSession, source: str, target: str, index: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """Rewrites the archives (.gz) at `source`, a member for each record, with an index of offsets."""
    schema = pa.schema([("archive", pa.string()), ("value", pa.binary()), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        task, n, size, members = TaskContext.get().partitionId(), 0, 0, []

        def volume():
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in members])]).tolist()
            return batch_of(schema, archive=[f"a{task:07d}-{n:05d}"], value=[b"".join(members)], offsets=[offsets])

        for x in records(lines_joined(batches)):
            members.append(deflated(x))
            size += len(x)
            if size >= volume_bytes:
                yield volume()
                n, size, members = n + 1, 0, []
        if members:
            yield volume()

    lines = spark.read.option("lineSep", "\n").text(source).select(F.col("value").cast("binary").alias("line"))
    made = written(lines.mapInArrow(run, "archive string, value binary, offsets array<long>"), "warc-members", "none")
    _to_files(made, target)
    made.select("archive", "offsets").write.option("compression", "zstd").parquet(index)


def read_records(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The rows of `record_types` as read from normalised archives through their index."""
    schema = pa.schema(_ROW)
    files = _files(spark, path).join(spark.read.schema("archive string, offsets array<long>").parquet(index), "archive")

    def run(batches):
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist(), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    headers, payload = parsed(zlib.decompress(data[a:b], _GZIP))
                    kind, page, size = headers["warc-type"], headers.get("x-page-id"), int(headers["x-payload-length"])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload of page {page} has changed")
                    to = headers.get("x-refers-to-page-id")
                    rows.append((None if page is None else int(page), size, digest, kind, None if to is None else int(to)))
                if rows:
                    yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return files.select("content", "offsets").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
