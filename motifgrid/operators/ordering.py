"""Places in an order of all rows, and what follows from them: chunks, ranks, exact medians, and pairs in or out of order.

Rows are range-partitioned by the order and written with their place inside the partition; a prefix sum over one
count a partition gives the place among all rows. No window runs over a whole table or a whole group, so
one group may hold most of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block of `discordant_pairs` at least.
LEAST_BLOCK = 1 << 12
#: Low bits of monotonically_increasing_id that count a partition's rows.
_ROW_BITS = 33


def placed(rows: DataFrame, *order: Column | str, place: str = "place") -> DataFrame:
    """rows with their place (from 0, without gaps) in the order; equal rows of the order go in any order."""
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    names = [f"__k{i}" for i in range(len(keys))]
    d = rows.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    d = d.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("__row", F.monotonically_increasing_id())
    d = written(d, "ordered")
    part, at = F.shiftright("__row", _ROW_BITS).cast("int"), F.col("__row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    parts = d.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return d.withColumn("__part", part).join(F.broadcast(parts), "__part").select(*rows.columns, (F.col("__before") + at).alias(place))


def joined_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group (one row a group); a null is a key like others."""
    names = {k: f"__g{i}" for i, k in enumerate(keys)}
    groups = groups.select(*[F.col(k).alias(n) for k, n in names.items()], *[k for k in groups.columns if k not in names])
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(groups, same, "left").drop(*names.values())


def placed_within(rows: DataFrame, group: list[str], *order: Column | str, place: str = "place") -> DataFrame:
    """rows with their place (from 0) in the order of their group; nulls are a group too."""
    d = placed(rows, *group, *order, place="__at")
    first = d.groupBy(*group).agg(F.min("__at").alias("__first"))
    return joined_groups(d, first, group).select(*rows.columns, (F.col("__at") - F.col("__first")).alias(place))


def exact_medians(rows: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """group and the exact median of the values that aren't null: the mean of both middle ones. Groups without values are left out."""
    held = rows.select(*group, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    d = placed(held, *group, "__v", place="__at")
    ends = d.groupBy(*group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    at = F.col("__at") - F.col("__first")
    middle = joined_groups(d, ends, group).filter((at == F.expr("(__n - 1) div 2")) | (at == F.expr("__n div 2")))
    return middle.groupBy(*group).agg(F.avg("__v").alias(name))


def nearest_values(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, target, gap, rank: the k rows (target, value) whose values are nearest to that of each query (query, value); of equal gaps the least target.

    They are among the first k rows from the query's value upward and the first k below it, each side in the order of distance, then target:
    places in the order of (value, target) give both, so no query meets all rows. Queries of one value are answered once. Nulls take no part;
    distinct values must be further apart than their differences are rounded.
    """
    d = placed(rows.filter("value is not null"), "value", "target").select("target", F.col("value").alias("__u"), "place")
    runs = d.groupBy("__u").agg(F.min("place").alias("__first"), F.count("*").alias("__n"))
    total = runs.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
    # downward: equal values still in the order of targets
    held = d.join(runs, "__u").crossJoin(F.broadcast(total))
    ends = F.array(F.struct(F.lit(1).alias("side"), F.col("place").alias("at")), F.struct(F.lit(-1).alias("side"), (F.col("__all") - F.col("__first") - F.col("__n") + F.col("place") - F.col("__first")).alias("at")))
    held = held.select("target", "__u", F.explode(ends).alias("e")).select("target", "__u", "e.*")
    # rows below a value: what the queries' values find when they are placed among them
    asked = queries.filter("value is not null").select("value").distinct()
    both = d.select(F.col("__u").alias("value"), F.lit(1).alias("row")).unionByName(asked.withColumn("row", F.lit(0)))
    below = placed(both, "value", "row", place="p")
    first = placed(asked, "value", place="before").join(below.filter("row = 0").select("value", "p"), "value")
    first = first.crossJoin(F.broadcast(total)).select("value", (F.col("p") - F.col("before")).alias("low"), "__all")
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("low").alias("at")), F.struct(F.lit(-1).alias("side"), (F.col("__all") - F.col("low")).alias("at")))
    wanted = first.select("value", F.explode(sides).alias("s")).select("value", "s.side", F.explode(F.sequence("s.at", F.col("s.at") + k - 1)).alias("at"))
    near = wanted.join(held, ["side", "at"]).select("value", "target", F.abs(F.col("__u") - F.col("value")).alias("gap"))
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("value").orderBy("gap", "target"))).filter(F.col("rank") <= k)  # 2 k rows a value
    return queries.join(best, "value").select("query", "target", "gap", "rank")


def inversions(values: np.ndarray) -> int:
    """Number of pairs i < j with values[i] > values[j], bit by bit from the top: groups of equal upper bits, then ones before zeros."""
    r = np.empty(len(values), np.int64)
    r[np.argsort(values, kind="stable")] = np.arange(len(values))
    total = 0
    for b in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        one, group = (r >> b) & 1, r >> (b + 1)
        ones = np.cumsum(one)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat((ones - one)[first], np.diff([*first, len(r)]))
        total += int((ones - before)[one == 0].sum())
        r = r[np.argsort(r >> b, kind="stable")]
    return total


def discordant_pairs(rows: DataFrame, x: str, y: str, tie: str, n: int) -> int:
    """Pairs of the n rows that x and y order strictly differently.

    Rows get their places in the order of (x, y, tie) and of (y, x, tie): the pairs are the inversions of one against the
    other. Both places are cut into blocks of n^(2/3) rows. Pairs of one block of either order are counted in tasks; those of
    different blocks in both follow from the number of rows by pair of blocks, n^(2/3) numbers.
    """
    size = max(LEAST_BLOCK, round(n ** (2 / 3)))
    d = placed(placed(rows.select(x, y, tie), x, y, tie, place="px"), y, x, tie, place="py")
    d = written(d.select("px", "py", F.floor(F.col("px") / size).alias("bx"), F.floor(F.col("py") / size).alias("by")), "places")

    def inside(key: str, value: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [inversions(frame.sort_values("px")[value].to_numpy())]})

        return d.groupBy(key).applyInPandas(run, "n long")

    blocks = -(-n // size)
    counts = d.groupBy("bx", "by").agg(F.count("*").alias("c"))
    grid = d.sparkSession.range(blocks * blocks).select(F.expr(f"id div {blocks}").alias("bx"), F.expr(f"id % {blocks}").alias("by")).join(counts, ["bx", "by"], "left").fillna(0, "c")
    earlier = W.partitionBy("by").orderBy("bx").rowsBetween(W.unboundedPreceding, -1)
    higher = W.partitionBy("bx").orderBy(F.desc("by")).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).withColumn("over", F.coalesce(F.sum("before").over(higher), F.lit(0)))
    apart = grid.select((F.col("c").cast("decimal(38,0)") * F.col("over")).cast("decimal(38,0)").alias("n"))
    # one bucket of y: any two rows; one block of x: rows of different buckets of y
    found = inside("by", "py").unionByName(inside("bx", "by")).select(F.col("n").cast("decimal(38,0)").alias("n")).unionByName(apart)
    return int(found.agg(F.sum("n").alias("n")).first().n or 0)


def concordant_share(rows: DataFrame, tie: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """share: of the pairs of rows without nulls, those that x and y order alike (ties in both included); null for fewer than two rows."""
    d = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def tied(*keys: str) -> int:
        n = d.groupBy(*keys).agg(F.count("*").cast("decimal(38,0)").alias("n"))
        return int(n.agg(F.sum(F.expr("n * (n - 1) / 2")).cast("decimal(38,0)").alias("n")).first().n or 0)

    n = d.count()
    pairs = n * (n - 1) // 2
    share = None
    if pairs:
        same = pairs - tied(x) - tied(y) + 2 * tied(x, y) - discordant_pairs(d, x, y, tie, n)
        share = same / pairs
    return rows.sparkSession.createDataFrame([(share,)], "share double")
