"""Operator 12: centroid clustering in whole numbers with Drake's adaptive bounds.

Vectors become integers floor(SCALE * x) and are written in blocks, one row a block. Beside its vectors a block holds
for each of them the NEAREST nearest centroids of the last look in their order, an upper bound on the distance to the first one
(its own), a lower bound on the distance to each other one, and one lower bound for all the rest.

When centroids have moved, a bound moves by as much. A vector whose own bound is below all others keeps its centroid
without any distance. Else its own distance is made exact; if this isn't enough, the bounds say
how many of the nearest centroids may now come first: these are compared exactly and put in order again. Only where the bound
of the rest doesn't hold either are all centroids scanned. Bounds are rounded outward, and a certificate needs a strict
inequality, so ties are always settled by exact integer distances, then by the smaller number.

Each round is one pass over the blocks, which writes the new state and each block's sums by cluster; the sums are added by Spark, and the
driver gets one number for each centroid and component. The table of the round before is then removed.

Defined results: a vector that is null, of another length, or holds a null or a component that isn't finite takes no part; components
and distances beyond 64 bits count as the nearest 64-bit integer, but all comparisons and sums are exact; rows
that repeat a vec_id are vectors of their own, a null vec_id is one too and starts no centroid while others are left; equal starting keys
go in the order of the vectors; with fewer vectors than centroids there are fewer centroids; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, removed, written

SCALE, NEAREST = 256, 6
#: Part of a bound that rounding may take at most, many times over.
SLACK = 1e-9
_MOST = (1 << 63) - 1
BLOCK = "n int, ids array<long>, held binary, width int, near binary, low binary, distance array<long>, parts array<struct<cluster:int,place:int,total:decimal(38,0)>>"
_PART = pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])
_BLOCK = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("width", pa.int32()), ("near", pa.binary()), ("low", pa.binary()), ("distance", pa.list_(pa.int64())), ("parts", pa.list_(_PART))])


def quantised(rows: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and integers v of the rows that take part."""
    v = rows[vector].cast("array<double>")
    good = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(good).select(rows[key].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def starting(rows: DataFrame, k: int, seed: str = "2") -> list[list[int]]:
    """The k vectors whose ids hash to the least values."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v").asc()
    return [r.v for r in rows.orderBy(*order).limit(k).collect()]  # k vectors


def exact(values: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers whose squared distances and partial sums are exact: doubles, 64-bit integers, or integers of any length."""
    most = max([abs(int(x)) for x in (values.min(), values.max())] + [abs(x) for c in centroids for x in c] if values.size else [1])
    bits = (4 * values.shape[1] * len(values) * most * most + 1).bit_length()
    kind = np.float64 if bits <= 53 else np.int64 if bits <= 62 else object
    return values.astype(kind), np.array(centroids, object).astype(kind)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Roots as 32-bit numbers that aren't below (or above) the exact ones."""
    return _outward(np.sqrt(squared.astype(np.float64)), 0.0, up)


def _outward(x: np.ndarray, scale: np.ndarray | float, up: bool) -> np.ndarray:
    """x, an estimate from numbers of size `scale`, as a 32-bit number beyond all rounding."""
    slack = (np.abs(x) + scale) * SLACK
    return np.nextafter((x + slack if up else x - slack).astype(np.float32), np.float32(np.inf if up else -np.inf))


class State:
    """Nearest centroids and bounds of a block. low[:, 0] is the upper bound, low[:, -1] the bound of the rest."""

    def __init__(self, near: np.ndarray, low: np.ndarray):
        self.near, self.low = near, low

    @classmethod
    def scanned(cls, values: np.ndarray, centroids: np.ndarray) -> State:
        held = min(NEAREST, len(centroids))
        state = cls(np.zeros((len(values), held), np.uint16), np.full((len(values), held + 1), np.inf, np.float32))
        state.scan(np.arange(len(values)), values, centroids)
        return state

    def scan(self, rows: np.ndarray, values: np.ndarray, centroids: np.ndarray) -> None:
        """All centroids, for some rows."""
        if not len(rows):
            return
        x, held = values[rows], self.near.shape[1]
        d = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
        order = np.argsort(d, axis=1, kind="stable")[:, : held + 1]
        d = np.take_along_axis(d, order, axis=1)
        self.near[rows] = order[:, :held]
        self.low[rows, 0] = _root(d[:, 0], True)
        self.low[rows, 1 : order.shape[1]] = _root(d[:, 1:], False)

    def moved(self, by: np.ndarray) -> None:
        """Centroids moved by so much each."""
        low, step = self.low.astype(np.float64), by[self.near]
        self.low[:, 0] = _outward(low[:, 0] + step[:, 0], low[:, 0], True)
        self.low[:, 1:-1] = _outward(low[:, 1:-1] - step[:, 1:], low[:, 1:-1] + step[:, 1:], False)
        self.low[:, -1] = np.where(np.isinf(low[:, -1]), np.float32(np.inf), _outward(np.where(np.isinf(low[:, -1]), 0, low[:, -1]) - by.max(), by.max(), False))

    def _places(self, rows: np.ndarray) -> np.ndarray:
        """How many of a row's other centroids may be as near as its own, in their order; as many as are held: maybe one of the rest too."""
        suffix = np.minimum.accumulate(self.low[rows, :0:-1], axis=1)[:, ::-1]
        return (suffix <= self.low[rows, :1]).sum(axis=1)

    def settle(self, values: np.ndarray, centroids: np.ndarray) -> tuple[int, int]:
        """Puts the nearest centroid of every row first; gives the number of distances that took, and of rows that were scanned."""
        rows = np.arange(len(values))
        rows = rows[self._places(rows) > 0]
        if not len(rows):
            return 0, 0
        apart = values[rows] - centroids[self.near[rows, 0]]
        self.low[rows, 0] = _root((apart * apart).sum(axis=1), True)
        made, places = len(rows), self._places(rows)
        held = self.near.shape[1]
        for z in range(1, held):
            some = rows[places == z]
            if not len(some):
                continue
            near = self.near[some, : z + 1]
            apart = values[some][:, None, :] - centroids[near]
            d = (apart * apart).sum(axis=2)
            order = np.argsort(near, axis=1)  # of equal distances the smaller number
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, axis=1), axis=1, kind="stable"), axis=1)
            self.near[some, : z + 1] = np.take_along_axis(near, order, axis=1)
            d = np.take_along_axis(d, order, axis=1)
            self.low[some, 0] = _root(d[:, 0], True)
            self.low[some, 1 : z + 1] = _root(d[:, 1:], False)
            made += d.size
        some = rows[places == held]
        self.scan(some, values, centroids)
        return made + len(some) * len(centroids), len(some)


def _sums(values: np.ndarray, own: np.ndarray, distance: np.ndarray) -> list[dict]:
    """Totals by cluster: of each component, then the number of vectors, then the distances."""
    order = np.argsort(own, kind="stable")
    clusters, first = np.unique(own[order], return_index=True)
    totals = np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]
    apart = np.add.reduceat(distance[order].astype(object), first) if len(first) else distance[:0]
    sizes = np.diff([*first, len(own)])
    return [{"cluster": int(c), "place": i, "total": int(x)} for c, row, n, d in zip(clusters, totals, sizes, apart, strict=True) for i, x in enumerate([*row, n, d])]


def _row(ids: pa.Array, held: np.ndarray, values: np.ndarray, centroids: np.ndarray, state: State) -> pa.RecordBatch:
    apart = values - centroids[state.near[:, 0]]
    distance = np.minimum((apart * apart).sum(axis=1), _MOST).astype(np.int64)
    offsets = [0, len(held)]
    return batch_of(
        _BLOCK, n=[len(held)], ids=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids), held=[held.tobytes()], width=[held.dtype.itemsize], near=[state.near.tobytes()], low=[state.low.tobytes()],
        distance=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(distance)), parts=[_sums(values, state.near[:, 0], distance)],
    )


def _opened(batch: pa.RecordBatch, dims: int, held: int):
    for i in range(batch.num_rows):
        n, width = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
        near, low, values = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in (("near", np.uint16), ("low", np.float32), ("held", f"<i{width}")))
        yield batch.column("ids")[i].values, values.reshape(n, dims), State(near.reshape(n, held).copy(), low.reshape(n, held + 1).copy())


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Blocks of the vectors with their nearest centroids, written."""
    dims = len(centroids[0])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max)
            values, own = exact(flat, centroids)
            yield _row(batch.column("vec_id"), flat.astype(kind), values, own, State.scanned(values, own))

    return written(rows.mapInArrow(run, BLOCK), "drake-blocks")


def reassigned(blocks: DataFrame, before: list[list[int]], centroids: list[list[int]]) -> DataFrame:
    """The blocks after the centroids have moved, written."""
    dims, held = len(centroids[0]), min(NEAREST, len(centroids))
    by = np.array([math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(before, centroids, strict=True)]) * (1 + SLACK)

    def run(batches):
        for batch in batches:
            for ids, raw, state in _opened(batch, dims, held):
                values, own = exact(raw, centroids)
                state.moved(by)
                state.settle(values, own)
                yield _row(ids, raw, values, own, state)

    return written(blocks.mapInArrow(run, BLOCK), "drake-blocks")


def totals(blocks: DataFrame) -> dict[int, dict[int, int]]:
    """By cluster and place, the totals of all blocks: one number for each centroid and component."""
    parts = blocks.select(F.explode("parts").alias("x")).groupBy("x.cluster", "x.place").agg(F.sum("x.total").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.collect():
        found.setdefault(r.cluster, {})[r.place] = int(r.total)
    return found


class Clusters(NamedTuple):
    """rows: vec_id, cluster and distance (squared) of every vector; inertia: the sum of distances of each cluster that isn't empty."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]


def clustered(rows: DataFrame, k: int, rounds: int, dims: int, seed: str = "2") -> Clusters:
    """Rows as `quantised` gives them; centroids are replaced by the floor of their vectors' mean in each round, then vectors are assigned once more."""
    spec = "vec_id long, cluster int, distance long"
    centroids = starting(rows, k, seed)
    if not centroids:
        return Clusters(rows.sparkSession.createDataFrame([], spec), [], {})
    blocks = assigned(rows, centroids)
    for _ in range(rounds):
        found = totals(blocks)
        new = [[found[c][i] // found[c][dims] for i in range(dims)] if c in found else held for c, held in enumerate(centroids)]
        moved = reassigned(blocks, centroids, new)
        removed(blocks)
        blocks, centroids = moved, new
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    held = min(NEAREST, len(centroids))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("near")[i].as_buffer(), np.uint16).reshape(-1, held)[:, 0]
                yield batch_of(schema, vec_id=batch.column("ids")[i].values, cluster=own.astype(np.int32), distance=batch.column("distance")[i].values)

    return Clusters(blocks.select("ids", "near", "distance").mapInArrow(run, spec), centroids, {c: x[dims + 1] for c, x in totals(blocks).items()})


def with_digests(found: Clusters) -> DataFrame:
    """The rows with cluster_inertia, inertia and centroid_sha256; one small row for each centroid is broadcast."""
    whole = min(sum(found.inertia.values()), _MOST)
    digests = [(c, min(found.inertia.get(c, 0), _MOST), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(found.centroids)]
    known = found.rows.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
