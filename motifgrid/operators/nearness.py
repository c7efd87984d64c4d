"""Numbers of rows, by class, whose values are near those of queries, without pairs of either.

Rows and questions are range-partitioned in the order of values, and tasks go through their part once with running counts by class.
What the parts before hold is a small table, a row a part and class. A question is a value: of an interval's lower end, which stands
before rows of its value, or of the upper end, after them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import written

#: Places of questions and of rows among equal values.
LOWER, ROW, UPPER = 0, 1, 2


def largest_gap(passes) -> float:
    """The largest number not below 0 that passes, where any below one that passes does too; -1 if none does. Found bit by bit."""
    if not passes(0.0):
        return -1.0
    low, high = 0, int(np.float64(np.inf).view(np.int64))
    if passes(float("inf")):
        return float("inf")
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if passes(float(np.int64(mid).view(np.float64))) else (low, mid)
    return float(np.int64(low).view(np.float64))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, and back."""
    i = x.view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def upper_ends(q: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The largest doubles whose rounded difference from q is at most gap."""
    low, high = _ordered(q + 0.0), np.full(len(q), _ordered(np.array([np.inf]))[0])
    for _ in range(64):
        mid = (low & high) + ((low ^ high) >> 1)
        value = np.where(mid < 0, np.int64(-(2**63)) - mid, mid).view(np.float64)
        within = value - q <= gap
        low, high = np.where(within, mid, low), np.where(within, high, mid)
    return np.where(gap == np.inf, np.inf, np.where(low < 0, np.int64(-(2**63)) - low, low).view(np.float64)) + 0.0


@F.pandas_udf(DoubleType())
def upper_end(q: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series(upper_ends(q.to_numpy(float), gap.to_numpy(float)))


@F.pandas_udf(DoubleType())
def nearer(gap: pd.Series) -> pd.Series:
    """The largest double below a gap; infinity stays."""
    g = gap.to_numpy(float)
    return pd.Series(np.where(g == np.inf, g, np.nextafter(g, -np.inf)))


def _tasks(d: DataFrame) -> int:
    return int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_order(d: DataFrame) -> DataFrame:
    return d.repartitionByRange(_tasks(d), "at", "kind").sortWithinPartitions("at", "kind")


def counted_below(rows: DataFrame, asked: DataFrame, levels: list[str]) -> DataFrame:
    """asked with the number of rows before its place: `below`, and below_{level} of those of its class, for each level.

    rows has value, n (how many) and the levels; asked has at, kind (LOWER or UPPER), the levels and other columns.
    """
    names, kinds = asked.columns, dict(asked.dtypes)
    held = [k for k in names if k not in ("at", "kind", *levels)]
    r = rows.select(F.col("value").alias("at"), F.lit(ROW).alias("kind"), *levels, *[F.lit(None).cast(kinds[k]).alias(k) for k in held], "n")
    d = _in_order(r.unionByName(asked.withColumn("n", F.lit(0).cast("long"))))
    counts = ["below", *[f"below_{k}" for k in levels]]

    def run(frames):
        carry = {k: {} for k in levels}
        total, part = 0, TaskContext.get().partitionId()
        for f in frames:
            n, ask = f["n"].to_numpy(), f["kind"].to_numpy() != ROW
            out = f.loc[ask, names].copy()
            out["below"] = (np.cumsum(n) + total)[ask]
            total += int(n.sum())
            for k in levels:
                codes, classes = pd.factorize(f[k])
                order = np.argsort(codes, kind="stable")
                sums, first = np.cumsum(n[order]), np.searchsorted(codes[order], np.arange(len(classes)))
                before = np.array([carry[k].get(c, 0) for c in classes], np.int64)
                own = np.zeros(len(n), np.int64)
                start = np.append(before - (sums[first] - n[order][first]), 0)  # the last for nulls
                own[order] = np.where(codes[order] < 0, 0, sums + start[codes[order]])
                out[f"below_{k}"] = own[ask]
                carry[k].update(zip(classes, (before + np.bincount(codes[codes >= 0], n[codes >= 0], len(classes)).astype(np.int64)).tolist()))
            yield out.assign(part=part, level=None, class_=None, total=None)
        ends = [("", "", total), *[(k, c, n) for k in levels for c, n in carry[k].items()]]
        yield pd.DataFrame(ends, columns=["level", "class_", "total"]).assign(part=part).reindex(columns=[*names, *counts, "part", "level", "class_", "total"]).astype(object)

    spec = ", ".join([*[f"{k} {kinds[k]}" for k in names], *[f"{c} long" for c in counts], "part int, level string, class_ string, total long"])
    d = written(d.mapInPandas(run, spec), "counted")
    ends = d.filter("level is not null").select("part", "level", "class_", "total")
    later = ends.select(F.col("part").alias("later")).distinct()
    before = ends.join(later, F.col("part") < F.col("later")).groupBy("later", "level", "class_").agg(F.sum("total").alias("before"))  # a row a part and class
    d = d.filter("level is null").drop("level", "class_", "total")
    for level, name in (("", "below"), *[(k, f"below_{k}") for k in levels]):
        own = before.filter(F.col("level") == level).select(F.col("later").alias("part"), F.col("class_").alias(level or "class_"), "before")
        own = own if level else own.drop("class_")
        d = d.join(own, ["part", level] if level else ["part"], "left").withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("before")
    return d.select(*names, *counts)


def other_below(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (at, class) with `other`: the largest value at or below it of a row (value, class) of another class; null where there is none."""
    names, kinds = asked.columns, dict(asked.dtypes)
    held = [k for k in names if k not in ("at", "class")]
    r = rows.select(F.col("value").alias("at"), "class", *[F.lit(None).cast(kinds[k]).alias(k) for k in held], F.lit(ROW).alias("kind"))
    d = _in_order(r.unionByName(asked.withColumn("kind", F.lit(UPPER))))

    def run(frames):
        part = TaskContext.get().partitionId()
        value, kind = np.zeros(0), np.zeros(0, object)  # the last row, and before it the last one of another class
        for f in frames:
            row, classes = f["kind"].to_numpy() == ROW, f["class"].to_numpy()
            last = np.cumsum(row) - 1 + len(value)
            value, kind = np.append(value, f["at"].to_numpy()[row]), np.append(kind, classes[row])
            begins = np.maximum.accumulate(np.where(np.append(True, kind[1:] != kind[:-1]), np.arange(len(kind)), 0)) if len(kind) else np.zeros(0, int)
            at, own = last[~row], classes[~row]
            if len(kind):
                place = np.where(at < 0, -1, np.where(kind[at] != own, at, begins[at] - 1))
                found = np.where(place < 0, np.nan, value[place])
            else:
                found = np.full(len(at), np.nan)
            out = f.loc[~row, names].copy()
            yield out.assign(other=pd.Series(found, index=out.index), part=part, value_=np.nan, kind_=None)
            if len(kind):
                keep = [x for x in (begins[-1] - 1, len(kind) - 1) if x >= 0]
                value, kind = value[keep], kind[keep]
        yield pd.DataFrame({"value_": value, "kind_": kind, "part": part}).reindex(columns=[*names, "other", "part", "value_", "kind_"]).astype(object)

    spec = ", ".join([*[f"{k} {kinds[k]}" for k in names], "other double, part int, value_ double, kind_ string"])
    d = written(d.mapInPandas(run, spec), "others")
    ends: dict[int, list] = {}
    for x in d.filter("kind_ is not null").select("part", "value_", "kind_").collect():  # two rows a part
        ends.setdefault(x.part, []).append((x.value_, x.kind_))
    before, last, other = [], None, None
    for part in range(_tasks(rows)):
        if last:
            before.append((part, *last, other and other[0]))
        found = sorted(ends.get(part, []), key=lambda x: x[0])
        if found:
            (first, top) = (found[0] if len(found) > 1 else None, found[-1])
            other = first or (last if last and last[1] != top[1] else other)
            last = top
    spark = rows.sparkSession
    before = spark.createDataFrame(before, "part int, last double, last_class string, last_other double")
    d = d.filter("kind_ is null").join(F.broadcast(before), "part", "left")
    came = F.when(F.col("last_class") != F.col("class"), F.col("last")).otherwise(F.col("last_other"))
    return d.select(*names, F.coalesce(F.when(~F.isnan("other"), F.col("other")), came).alias("other"))
