"""Operator 5: exact top-k by inner product over a bit-sliced index.

Components become floor(SCALE * x). Rows are dealt into shards of SHARD_ROWS; a shard's index holds, for each
attribute, one bitmap over the shard's rows for each of the upper bits of the shifted, so unsigned,
value: the low DROPPED bits stay out, which leaves a known error bound. A query adds the slices of all
attributes, weighted by the bits of its own components, with bitmap arithmetic: slices of equal weight
go through full adders (three in, a sum and a carry out) until each weight has one slice. From the most significant
slice downward the best rows are selected; rows within the error bound of the last of them are the
boundary, and are scored exactly.

Queries are a stated set and grow with the table, so they are neither broadcast nor copied to every shard by a
shuffle: shards and blocks of queries are written tables, and each task of their product reads a few files of
either. A block has QUERY_ROWS queries, more (to MOST_QUERY_ROWS) where there are many, so that a shard is handed
over less often. A shard answers k rows to a query, and the k best of each query come from these.

Defined results: a row whose vector is null, or holds a null or a component that isn't finite
takes no part, nor does one without vec_id; shorter vectors, empty ones too, count as if padded with zeros. Values are
64-bit integers (a component beyond them counts as the nearest one). Where a shard's values and a query's could add up to more than 62 bits,
the shard's rows are scored with integers of any length in place of slices; a score beyond 64 bits is given as the
nearest 64-bit integer, ranked by up to 38 digits. Rows that repeat a vec_id are queries each and candidates each, of each other too; ties
go to the smaller vec_id; with fewer candidates there are fewer rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, written

SCALE = 256
#: Sums of more bits than this are made with integers of any length.
SUM_BITS = 62
#: Scores are ranked by so large a number at most.
WIDEST = 10**38 - 1
SHARD_ROWS, QUERY_ROWS, DROPPED = 4096, 64, 2
#: Queries of a block at most, and pairs of shard and block that are enough to keep tasks busy.
MOST_QUERY_ROWS, ENOUGH_CELLS = 2048, 512


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id and the integers v of the rows that take part, written to the shared folder."""
    v = rows[vector].cast("array<double>")
    good = rows[key].isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(v, lambda x: F.floor(x * SCALE).cast("long"))
    return written(rows.filter(good).select(F.monotonically_increasing_id().alias("row"), rows[key].cast("long").alias("vec_id"), held.alias("v")), "bit-sliced-rows")


def packed_blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Blocks of about `most` rows, and their number: block (from 0; empty ones are missing), row numbers, ids and values (binary; 32-bit values where they fit), components."""
    parts = -(-rows.count() // most) or 1
    schema = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("held", pa.binary()), ("dims", pa.int32())])

    def run(batches):
        numbers, ids, values = [], [], []
        for batch in batches:
            numbers += batch.column("row").to_pylist()
            ids += batch.column("vec_id").to_pylist()
            column = batch.column("v")
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            values += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if ids:
            full = np.zeros((len(ids), max(1, *map(len, values))), np.int64)  # empty vectors are a zero
            for i, x in enumerate(values):
                full[i, : len(x)] = x
            if full.min() >= -(1 << 31) and full.max() < 1 << 31:
                full = full.astype(np.int32)
            yield batch_of(schema, block=[TaskContext.get().partitionId()], rows=[np.array(numbers, np.int64).tobytes()], ids=[np.array(ids, np.int64).tobytes()], held=[full.tobytes()], dims=[full.shape[1]])

    return rows.repartition(parts).mapInArrow(run, "block int, rows binary, ids binary, held binary, dims int"), parts


def unpacked(held: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    data = held.as_buffer()
    return np.frombuffer(data, np.int32 if data.size == 4 * rows * dims else np.int64).reshape(rows, dims)


class Index:
    """Bitmaps of a shard's upper bits, by attribute."""

    def __init__(self, values: np.ndarray, dropped: int = DROPPED):
        self.values, self.n = values.astype(np.int64), len(values)
        self.most = max(abs(int(self.values.min())), abs(int(self.values.max())), 1)
        self.slices = None
        if (2 * self.most).bit_length() > SUM_BITS:
            return
        self.low = self.values.min(axis=0)
        top = self.values - self.low
        self.dropped = min(dropped, int(top.max()).bit_length())
        top >>= self.dropped
        self.bits = max(1, int(top.max()).bit_length())
        pad = -self.n % 64
        planes = (top.T[:, None, :] >> np.arange(self.bits)[:, None]) & 1
        planes = np.pad(planes.astype(np.uint8), ((0, 0), (0, 0), (0, pad)))
        self.slices = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)

    def fits(self, query: np.ndarray) -> bool:
        """Whether no sum of products with the query has more than SUM_BITS bits."""
        asked = max(abs(int(query.min())), abs(int(query.max())), 1)
        return self.slices is not None and (2 * self.most * asked * len(query)).bit_length() <= SUM_BITS

    def added(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum over attributes of non-negative weights."""
        weights = max(1, int(query.max()).bit_length())
        levels: list[list[np.ndarray]] = [[] for _ in range(weights + self.bits + len(query).bit_length() + 2)]
        for w in range(weights):
            chosen = self.slices[(query >> w) & 1 == 1]
            for b in range(self.bits):
                levels[w + b].append(chosen[:, b])
        out = []
        for at in range(len(levels)):
            held = np.concatenate(levels[at]) if levels[at] else np.empty((0, self.slices.shape[2]), np.uint64)
            while len(held) > 1:
                if len(held) == 2:
                    a, b = held
                    levels[at + 1].append((a & b)[None])
                    held = (a ^ b)[None]
                else:
                    n = len(held) // 3
                    a, b, c = held[:n], held[n : 2 * n], held[2 * n : 3 * n]
                    x = a ^ b
                    levels[at + 1].append((a & b) | (x & c))
                    held = np.concatenate([x ^ c, held[3 * n :]])
            out.append(held[0] if len(held) else np.zeros(self.slices.shape[2], np.uint64))
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows that hold the k best of the allowed ones (a bitmap), and all that tie with the last."""
        query = query.astype(np.int64)
        up, down = np.maximum(query, 0), np.maximum(-query, 0)
        slices = self._both(up, down)
        slack = (up.sum() + down.sum()) * ((1 << self.dropped) - 1) >> self.dropped
        best, floor = allowed.copy(), 0
        count = int(np.bitwise_count(best).sum())
        if count <= k:
            return np.flatnonzero(np.unpackbits(best.view(np.uint8), bitorder="little")[: self.n])
        sure, left = 0, k
        for at in range(len(slices) - 1, -1, -1):  # the k-th best sum, from the most significant slice down
            ones = best & slices[at]
            n = int(np.bitwise_count(ones).sum())
            if n >= left:
                best, floor = ones, floor | 1 << at
            else:
                left -= n
                sure += n
                best &= ~slices[at]
        least = max(0, floor - int(slack) - 1)
        over, same = np.zeros_like(allowed), allowed.copy()
        for at in range(len(slices) - 1, -1, -1):  # rows whose sum is at least `least`
            if least >> at & 1:
                same &= slices[at]
            else:
                over |= same & slices[at]
                same &= ~slices[at]
        rows = over | same
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[: self.n])

    def _both(self, up: np.ndarray, down: np.ndarray) -> list[np.ndarray]:
        held, slices = self.slices, self.slices.copy()
        slices[down > 0] = ~held[down > 0]  # the mirrored value of an attribute with a negative weight
        self.slices = slices
        try:
            return self.added(up + down)
        finally:
            self.slices = held


def answered(numbers: np.ndarray, ids: np.ndarray, index: Index, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """vec_ids and scores of the k best rows of a shard for the query of row number `row`."""
    if index.fits(query):
        allowed = np.pad((numbers != row).astype(np.uint8), (0, -len(ids) % 64))
        rows = index.top(query, k, np.packbits(allowed, bitorder="little").view(np.uint64))
        scores = index.values[rows] @ query.astype(np.int64)
    else:
        rows = np.flatnonzero(numbers != row)
        scores = index.values[rows].astype(object) @ query.astype(object)
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k] if scores.dtype == object else np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][order], [int(scores[i]) for i in order]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query; both are rows of `quantised`."""
    shards, parts = packed_blocks(rows, shard_rows)
    shards = written(shards, "bit-sliced-shards", "none")
    query_rows = query_rows or max(QUERY_ROWS, min(MOST_QUERY_ROWS, queries.count() * parts // ENOUGH_CELLS))
    blocks, _ = packed_blocks(queries, query_rows)
    blocks = written(blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "held", "dims")]), "bit-sliced-queries", "none")
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("wide", pa.string())])

    def run(batches):
        last, index, ids, numbers = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if (shard := row["block"].as_py()) != last:
                    ids, numbers = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("ids", "rows"))
                    last, index = shard, Index(unpacked(row["held"], len(ids), row["dims"].as_py()))
                asked, own = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("q_ids", "q_rows"))
                held = unpacked(row["q_held"], len(asked), row["q_dims"].as_py())
                dims = index.values.shape[1]
                held = np.pad(held[:, :dims], ((0, 0), (0, max(0, dims - held.shape[1]))))
                found = [answered(numbers, ids, index, int(a), q, k) for a, q in zip(own, held, strict=True)]
                n = [len(x) for x, _ in found]
                yield batch_of(schema, row=np.repeat(own, n), query_id=np.repeat(asked, n), vec_id=np.concatenate([x for x, _ in found]), wide=[str(max(-WIDEST, min(WIDEST, s))) for _, x in found for s in x])

    # a product by partitions: a task goes through its blocks of queries shard by shard; the hint keeps Spark from collecting a side on the driver
    near = shards.hint("shuffle_replicate_nl").crossJoin(blocks).select("block", "rows", "ids", "held", "dims", "q_rows", "q_ids", "q_held", "q_dims")
    near = near.mapInArrow(run, "row long, query_id long, vec_id long, wide string").withColumn("wide", F.col("wide").cast("decimal(38,0)"))
    order = W.partitionBy("row").orderBy(F.desc("wide"), "vec_id")
    score = F.least(F.greatest("wide", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
