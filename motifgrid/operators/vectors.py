"""Joins and aggregates on vectors: similarity pairs, neighbour graphs, medians and medoids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import jaccard_similarity
from ..functions.vectors import total
from ..sources.shared import written
from .ordering import exact_medians, joined_groups


#: Rows of a block have about this many rows for each root of all rows of its list.
_SPREAD = 8
#: A list has this many blocks at most, as long as a block holds no more than _BLOCK_VALUES numbers.
_BLOCKS, _BLOCK_VALUES = 16, 1 << 20
#: Part of a bound that rounding may take.
_SLACK = 1e-9
#: Rows of a piece of a pair of blocks; pairs that are taken exactly at once; a total, as part of the greatest, below which single floats don't bound.
_TILE, _AT_ONCE, _TINY = 512, 1 << 12, 1e-12


def _prefixes(d: DataFrame, least: float) -> tuple[np.ndarray, Callable[[pd.DataFrame], tuple[np.ndarray, ...]]]:
    """The order of the components, rarest first, and a function that gives for a frame (t, vec) its vectors in that order, and the row and component of each vector's prefix.

    Similar vectors share at least the part `least` of either total in their minima. A vector's prefix ends where the components behind it hold
    less than that, so two similar vectors have their first common component in both prefixes.
    """
    counts = d.select(F.posexplode("vec").alias("dim", "x")).filter("x > 0").groupBy("dim").agg(F.count("*").alias("n"))
    order = np.array([r.dim for r in counts.orderBy("n", "dim").collect()], int)  # one row for each component that vectors have

    def of(f: pd.DataFrame) -> tuple[np.ndarray, ...]:
        v = np.stack(f["vec"].to_numpy()).astype(float)[:, order]
        after = np.cumsum(v[:, ::-1], axis=1)[:, ::-1]  # each component and those behind it
        return v, *np.nonzero((v > 0) & (after >= least * f["t"].to_numpy()[:, None] * (1 - _SLACK)))

    return order, of


def _typed(d: DataFrame, *names: str) -> list[str]:
    return [f"`{k}` {d.schema[k].dataType.simpleString()}" for k in names]


def _postings(d: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """keys, dim, id, t, vec of the components in each vector's prefix (see `_prefixes`); dim and vec follow the order of the components."""
    _, of = _prefixes(d, least)
    spec = ", ".join([*_typed(d, *keys), "dim int", *_typed(d, "id"), "t double", "vec array<double>"])

    def run(frames):
        for f in frames:
            if len(f):
                v, row, dim = of(f)
                yield f.iloc[row].reset_index(drop=True).assign(dim=dim.astype(np.int32), vec=[v[i] for i in row])[[*keys, "dim", "id", "t", "vec"]]

    return d.select(*keys, "id", "t", "vec").mapInPandas(run, spec)


def _list_sizes(d: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """keys, dim, n: how long the lists of `_postings` would be, without making them."""
    _, of = _prefixes(d, least)

    def run(frames):
        for f in frames:
            if len(f):
                _, row, dim = of(f)
                yield f[keys].iloc[row].assign(dim=dim.astype(np.int32)).groupby([*keys, "dim"], dropna=False).size().reset_index(name="n")

    return d.select(*keys, "t", "vec").mapInPandas(run, ", ".join([*_typed(d, *keys), "dim int", "n long"])).groupBy(*keys, "dim").agg(F.sum("n").alias("n"))


def _bounding(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Features whose inner product is at least the sum of minima of two vectors, of non-negative components up to the last edge.

    A component is cut at the edges; of two parts x and y of a piece of width w, xy/w + sqrt(x(w-x)y(w-y))/w is their minimum where
    one is empty or full or both are equal, and more elsewhere: with x < y, the minimum less xy/w is x(w-y)/w, and x(w-y) is at most that root.
    """
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        w = np.where(high > low, high - low, 1)
        x = np.clip(v - low, 0, high - low)
        out += [x / np.sqrt(w), np.sqrt(x * np.maximum(w - x, 0) / w)]
    return np.concatenate(out, axis=1).astype(np.float32)


def _edges(v: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Edges for `_bounding`: 0, two quantiles of the positive components (of some vectors: any edges bound), and the greatest."""
    some = v[:: max(1, len(v) // 512)][:512]
    middle = [[float(np.quantile(x[x > 0], q)) if (x > 0).any() else 0.0 for x in some.T] for q in (0.4, 0.75)]
    return np.array([np.zeros(v.shape[1]), *middle, top])


def _near(v: np.ndarray, w: np.ndarray | None, t: np.ndarray, u: np.ndarray, least: float, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of v and j of w with a similarity of `least` or more, and it, piece by piece; v and w in the order of their totals t and u, w None for the pairs i < j of v.

    A matrix product of features bounds the sums of minima of a piece; where the bound reaches `least`, the similarity is taken.
    """
    same = w is None
    w = v if same else w
    scale = max(t[-1], u[-1])
    edges = _edges(w, np.maximum(v.max(axis=0), w.max(axis=0))) / scale
    one = _bounding(v / scale, edges)
    two = one if same else _bounding(w / scale, edges)
    part = np.float32(least / (1 + least) * (1 - _SLACK - one.shape[1] * 2.0**-22))  # sums of non-negative single floats
    ts, us = (t / scale).astype(np.float32), (u / scale).astype(np.float32)
    for a in range(0, len(v), _TILE):
        b = min(a + _TILE, len(v))
        lo, hi = int(np.searchsorted(u, t[a] * least * (1 - _SLACK))), int(np.searchsorted(u, t[b - 1] / least * (1 + _SLACK), side="right"))
        for c in range(max(lo, a) if same else lo, hi, 2 * _TILE):
            e = min(c + 2 * _TILE, hi)
            bound = one[a:b] @ two[c:e].T
            over = bound >= np.add.outer(part * ts[a:b], part * us[c:e])
            over[ts[a:b] < _TINY] = True
            i, j = np.divmod(np.flatnonzero(over), e - c)
            i, j, found = i + a, j + c, []
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), _AT_ONCE):
                x, y = i[k : k + _AT_ONCE], j[k : k + _AT_ONCE]
                if dim > 0:
                    fresh = ~((v[x, :dim] > 0) & (w[y, :dim] > 0)).any(axis=1)
                    x, y = x[fresh], y[fresh]
                sim = np.minimum(v[x], w[y]).sum(axis=1) / np.maximum(v[x], w[y]).sum(axis=1)
                found.append((x[sim >= least], y[sim >= least], sim[sim >= least]))
            if found:
                yield tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: halves of the shortest decimals go up."""
    out = np.round(x, digits)
    close = np.flatnonzero(np.abs(np.abs(x - out) * 10.0**digits - 0.5) < 1e-6)
    out[close] = [float(Decimal(repr(float(k))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for k in x[close]]
    return out


class _Best:
    """The k best pairs of each node among those added: the most similar by rounded similarity, of equals those with the least other id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.held, self.n = k, digits, [], 0

    def add(self, node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.held.append((node, other, sim))
        self.n += len(node)
        if self.n > 2 * _BLOCK_VALUES:
            left = self.left()
            self.held, self.n = [left], len(left[0]) // 2  # half of what is left counts: most nodes have their k by now

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, other, sim = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((other, -_rounded(sim, self.digits), node))
        node, other, sim = node[order], other[order], sim[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[: len(node)])
        keep = np.arange(len(node)) - np.repeat(first, np.diff([*first, len(node)])) < self.k
        return node[keep], other[keep], sim[keep]


def _compared(lists: DataFrame, least: float, keys: list[str], sizes: DataFrame, sure: float | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """The similar pairs of each list (keys, dim): a list is dealt into blocks, and a task compares a pair of blocks, in pieces.

    dim is -1 for a list of whole vectors; else a pair counts only in the list of its first common component. With `sure`, a task gives
    sim and n in place of pairs: those of `sure` or more are one row with their number. With `best` (k, digits), it gives a (node), b and sim
    of the k best pairs that it has for each node.
    """
    at = [*keys, "dim"]
    rows = F.col("n").cast("double")
    d = joined_groups(lists, sizes.select(*at, "n"), at)
    blocks = F.greatest(F.least(F.ceil(F.sqrt(rows) / _SPREAD), F.lit(_BLOCKS)), F.ceil(rows * F.size("vec") / _BLOCK_VALUES)).cast("int")
    d = d.withColumn("blocks", blocks)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, block).alias("x"), F.greatest(j, block).alias("y")))
    d = d.select(*at, "id", "vec", "t", block.alias("block"), F.explode(cells).alias("cell")).select(*at, "id", "vec", "t", "block", "cell.x", "cell.y")
    spec = ", ".join([*_typed(d, *keys), "a long, b long, sim double" if sure is None else "sim double, n long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["t", "id"], kind="stable")
        x, y, dim = (int(frame[k].iloc[0]) for k in ("x", "y", "dim"))
        own = [frame[k].iloc[0] for k in keys]

        def made(**columns) -> pd.DataFrame:
            out = pd.DataFrame(columns)
            for k, value in zip(reversed(keys), reversed(own), strict=True):
                out.insert(0, k, value)
            return out

        sides = [(np.stack(f["vec"].to_numpy()).astype(float), f["id"].to_numpy(), f["t"].to_numpy()) for f in (frame[frame["block"] == k] for k in dict.fromkeys((x, y))) if len(f)]
        del frame
        many, held = 0, _Best(*best) if best else None
        if len(sides) == len({x, y}):
            (v, ids, t), (w, others, u) = sides[0], sides[-1]
            for i, j, sim in _near(v, None if x == y else w, t, u, least, dim):
                a, b = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
                if held:
                    held.add(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim]))
                elif sure is None:
                    yield made(a=a, b=b, sim=sim)
                else:
                    many += int((sim >= sure).sum())
                    if (sim < sure).any():
                        yield made(sim=sim[sim < sure], n=1)
        if held and held.n:
            yield made(**dict(zip(("a", "b", "sim"), held.left(), strict=True)))
        if sure is not None and many:
            yield made(sim=[sure], n=[many])

    return d.groupBy(*at, "x", "y").applyInPandas(run, spec)


def similar_pairs(vectors: DataFrame, least: float = 0.5, group: str | None = None, index: bool | None = None, sure: float | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """a < b and sim >= least (over 0) of vectors (id, vec; all of one length, without negative components); with `group`, inside its values only.

    The index holds a list for each component in a vector's prefix (see `_prefixes`); pairs are checked exactly in the list of their first
    common component, so none is missed and none comes twice. The similarity of two vectors is at most the ratio of their totals, so
    inside a list a vector meets only those whose total lies within 1 / least; a matrix product bounds their similarity, and
    what may reach `least` is taken exactly. Only similar pairs leave a task.

    index: None takes the index if its lists give fewer comparisons than all pairs of (a group of) vectors would, which is so where
    components are sparse; the rows are the same either way. The lists are counted, not cut.
    sure: gives group, sim, n in place of pairs; best: only each task's best pairs of each node (see `_compared` for both).
    """
    d = vectors.withColumn("t", total(F.col("vec"))).filter("t > 0")
    keys = [group] if group else []
    if index is not False:
        sizes = written(_list_sizes(d, least, keys), "list-sizes")  # one row for each component and group
        if index is None:
            square = F.coalesce(F.sum(F.col("n").cast("double") ** 2), F.lit(0.0)).alias("n")
            index = sizes.agg(square).first().n < d.groupBy(*keys).agg(F.count("*").alias("n")).agg(square).first().n
        if index:
            return _compared(_postings(d, least, keys), least, keys, sizes, sure, best)
    whole = d.withColumn("dim", F.lit(-1))
    return _compared(whole, least, keys, whole.groupBy(*keys, "dim").agg(F.count("*").alias("n")), sure, best)


def nearest_neighbours(vectors: DataFrame, least: float, k: int, digits: int = 6) -> DataFrame:
    """a < b, sim: the union of each node's k most similar neighbours of `least` or more, by similarity rounded to `digits`, of equals the least id.

    A task keeps the k best of each node among the pairs that it compares, so shuffles hold k rows a node and pair of blocks, however many are similar.
    """
    near = similar_pairs(vectors, least, best=(k, digits)).select(F.col("a").alias("x"), F.col("b").alias("y"), (F.round("sim", digits) + 0.0).alias("sim"))
    return _united(near, k)


def neighbour_graph(pairs: DataFrame, k: int) -> DataFrame:
    """a < b, sim: the union of each node's k most similar neighbours."""
    both = pairs.select(F.explode(F.expr("array(struct(a as x, b as y, sim), struct(b as x, a as y, sim))")).alias("e")).select("e.*")
    return _united(both, k)


def _united(both: DataFrame, k: int) -> DataFrame:
    top = both.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy(F.desc("sim"), "y"))).filter(F.col("rank") <= k)
    return top.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim").distinct()


def cluster_median(vectors: DataFrame) -> DataFrame:
    """cluster, dim, median of vectors (cluster, vec)."""
    return exact_medians(vectors.select("cluster", F.posexplode("vec").alias("dim", "x")), ["cluster", "dim"], "x")


def pairs_over(vectors: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """cluster, kind, n: how many pairs of a cluster's vectors (cluster, id, vec) have a rounded similarity of `least` or more (edge), and how many haven't (none)."""
    near = similar_pairs(vectors, least - 10.0**-digits, "cluster", sure=least).filter(F.round("sim", digits) >= least).groupBy("cluster").agg(F.sum("n").alias("edge"))
    all_ = vectors.groupBy("cluster").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))
    d = joined_groups(all_, near, ["cluster"]).select("cluster", F.coalesce("edge", F.lit(0)).alias("edge"), "pairs")
    kinds = F.array(F.struct(F.lit("edge").alias("kind"), F.col("edge").alias("n")), F.struct(F.lit("none").alias("kind"), (F.col("pairs") - F.col("edge")).alias("n")))
    return d.select("cluster", F.explode(kinds).alias("x")).select("cluster", "x.*").filter("n > 0")


def cluster_medoid(vectors: DataFrame) -> DataFrame:
    """cluster, medoid, far: the vector with the least sum of distances (1 - similarity; 1 to a vector of zeros) to its cluster; the least id of equals.

    The sum takes all pairs of a cluster, but none leaves a task: vectors are dealt into blocks, a task sums over a pair of blocks and
    gives a part of the sum for each of its vectors.
    """
    sizes = vectors.groupBy("cluster").agg(F.ceil(F.sqrt(F.count("*").cast("double")) / _SPREAD).cast("int").alias("blocks"))
    d = joined_groups(vectors.select("cluster", "id", "vec"), sizes, ["cluster"])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, block).alias("x"), F.greatest(j, block).alias("y")))
    d = d.select("cluster", "id", "vec", block.alias("block"), F.explode(cells).alias("cell")).select("cluster", "id", "vec", "block", "cell.x", "cell.y")
    kinds = dict(vectors.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame["x"].iloc[0]), int(frame["y"].iloc[0])
        a, b = (frame[frame["block"] == k] for k in (x, y))
        if not len(a) or not len(b):
            return pd.DataFrame({"cluster": [], "a": [], "part": []})
        sim = jaccard_similarity(*(np.stack(k["vec"].to_numpy()).astype(float) for k in (a, b)))
        ids, parts = (a["id"], (1 - sim).sum(axis=1)) if x == y else (pd.concat([a["id"], b["id"]]), np.concatenate([(1 - sim).sum(axis=1), (1 - sim).sum(axis=0)]))
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]] * len(ids), "a": ids.to_numpy(), "part": parts})

    parts = d.groupBy("cluster", "x", "y").applyInPandas(run, f"cluster {kinds['cluster']}, a {kinds['id']}, part double")
    far = parts.groupBy("cluster", "a").agg(F.round(F.sum("part"), 9).alias("far"))
    return far.groupBy("cluster").agg(F.min(F.struct("far", "a")).alias("x")).select("cluster", F.col("x.a").alias("medoid"), F.col("x.far").alias("far"))


def rolled(items: DataFrame, keep: list[str], value: str) -> DataFrame:
    """Means over the dropped dimensions, then scaled to [0, 1] over all items."""
    d = items.groupBy(*keep).agg(F.avg(value).alias("mean"))
    low, high = F.min("mean").over(W.partitionBy()), F.max("mean").over(W.partitionBy())  # one row a bin
    return d.select(*keep, "mean", F.try_divide(F.col("mean") - low, high - low).alias("scaled"))
