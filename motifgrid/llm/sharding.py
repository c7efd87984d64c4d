"""Operator 9: proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is
(rank + 1/2) / rows of the source. All rows are sorted by fractional rank and cut into `shards` runs
whose row counts differ by one at most, so every run holds the sources in the corpus's proportions
(to within one row of each source). Ranks are not taken in a window over a source, which may hold
most rows: rows are range-partitioned by (source, hash), numbered in their partition, and the
partition's counts (one row for each partition and source) are added up. The same is done for the
cut by fractional rank.

Defined results: null is a source of its own; a null text has no bytes; equal rows of the hash are
ordered by doc_id, checksum and size, and rows equal in all of these are interchangeable, so equal
rows get different slots; with fewer rows than shards some shards stay empty; other columns are left
out. Row counts are the law: equal texts may go to different shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Bytes that a stored row has besides its text.
ROW_BYTES = 16


def numbered(df: DataFrame, keys: list[str], group: str | None, name: str) -> DataFrame:
    """df in the order of `keys`, written, with part and place (from 0 in part, or in part and group)."""
    spec = ", ".join(f"`{k}` {t}" for k, t in df.dtypes) + ", part int, place long"

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0  # groups come in runs
        for batch in batches:
            if not batch.num_rows:
                continue
            if group is None:
                place = np.arange(n, n + batch.num_rows)
                n += batch.num_rows
            else:
                code = batch.column(group).dictionary_encode()
                ids = code.indices.to_numpy(zero_copy_only=False)
                values = code.dictionary.to_pylist()
                place, starts = np.empty(batch.num_rows, np.int64), np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                    value = values[ids[a]]
                    n = n if value == last else 0
                    place[a:b] = np.arange(n, n + b - a)
                    last, n = value, n + int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, spec), name)


def sharded(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
    )
    rows = rows.withColumn("mix", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    first = numbered(rows, ["stratum", "mix", "doc_id", "text_crc32", "size"], "stratum", "sharding-sources")
    counts = first.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    within = W.partitionBy("stratum")
    counts = counts.select("stratum", "part", F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(within).alias("total"))
    ranked = first.join(counts, ["stratum", "part"]).select("doc_id", "size", "text_crc32", "mix", ((F.col("before") + F.col("place") + 0.5) / F.col("total")).alias("fraction"))
    second = numbered(ranked, ["fraction", "mix", "doc_id", "text_crc32", "size"], None, "sharding-order")
    parts = second.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    out = second.join(F.broadcast(parts), "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("place")).alias("at"), "total", F.expr(f"(before + place) * {shards} div total").cast("int").alias("shard"))
    first_of = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first_of).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
