"""Operator 1: token ids in ORC files.

Documents are range-partitioned by doc_id, sorted, encoded and written as ORC: ids are an integer
array, which ORC stores in run-length encoded streams; every stripe has a row index, and doc_id has
Bloom filters. Spark reads stripes in parallel and skips stripes and row groups by the statistics and
filters of doc_id (`read_tokens`). File names and rows ascend by (doc_id, hash of the text).

Defined results: a null or empty text holds only the end id; a null doc_id comes first; rows that
share a doc_id follow each other by the hash of their texts, repeated rows included; other columns
are left out; an empty table gives an empty file set. Nothing is collected: the only small table is
one count a partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, pieces, texts
from .tokens import library_encoder

FILE_SCHEMA = "part int, part_start long, doc_id long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Writes the ids of all documents (doc_id, text) to ORC files at `path`."""
    schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part, start = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", 1 << 20):
            ids = [x + end for x in encoder.encode(texts(batch.column("text")))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield batch_of(schema, part=np.full(len(n), part, np.int32), part_start=start + at[:-1], doc_id=batch.column("doc_id"), n_tokens=n.astype(np.int32), ids=pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat))
            start += int(at[-1])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (
        rows.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write
        .option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; a range of doc_id or a list of them prunes stripes and row groups."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.filter(F.col("doc_id").isin(ids)) if ids is not None else rows


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    rows = read_tokens(spark, path)
    schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            at = column.offsets.to_numpy().astype(np.int64)
            held = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            yield batch_of(schema, part=batch.column("part"), part_start=batch.column("part_start"), doc_id=batch.column("doc_id"), n_tokens=np.diff(at), ids_crc32=[zlib.crc32(held[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)])

    found = rows.mapInArrow(run, "part int, part_start long, doc_id long, n_tokens long, ids_crc32 long")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
