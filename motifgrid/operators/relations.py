"""Filters, joins, set operations, chunks and samples on proteins, pairs and letters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import placed, placed_within

#: Names that are never used.
BAD_NAMES = ("d1e25a_", "d1o7d.2", "d1o7d.3")


def without_names(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys is among the names (one column)."""
    for key in keys:
        rows = rows.join(names.toDF(key), key, "left_anti")
    return rows


def pairs_with(pairs: DataFrame, proteins: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (prot1, prot2) whose members are known (prot_id, len), and no longer than `most`."""
    for side in ("prot1", "prot2"):
        known = proteins if most is None else proteins.filter(F.col("len") <= most)
        pairs = pairs.join(known.select(F.col("prot_id").alias(side)), side, "left_semi")
    return pairs


def key_length_report(one: DataFrame, two: DataFrame) -> DataFrame:
    """prot_id, len1, len2 where a name is missing or the lengths differ."""
    d = one.select("prot_id", F.col("len").alias("len1")).join(two.select("prot_id", F.col("len").alias("len2")), "prot_id", "full_outer")
    return d.filter(~F.col("len1").eqNullSafe(F.col("len2")))


def guarded(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs; the query fails if one holds a bad name."""
    for side in ("prot1", "prot2"):
        bad = names.toDF("__bad").distinct()
        checked = F.when(F.col("__bad").isNotNull(), F.raise_error(F.lit("a pair holds an excluded name"))).otherwise(F.col(side))
        pairs = pairs.join(bad, F.col(side) == F.col("__bad"), "left").withColumn(side, checked.cast(pairs.schema[side].dataType)).select(*pairs.columns)
    return pairs


def key_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Keys of one side only, with the side."""
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))


def of_split(rows: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """Rows whose key belongs to a split (key, split)."""
    return rows.join(splits.filter(F.col("split") == split).select(key), key, "left_semi")


def common_names(one: DataFrame, two: DataFrame) -> DataFrame:
    """Distinct names (one column) that both lists hold."""
    return one.intersect(two)


def names_without(lists: list[DataFrame], bad: DataFrame) -> DataFrame:
    """Distinct names of any of the lists (one column) that aren't bad."""
    whole = gathered(lists).distinct()
    return without_names(whole, bad, *whole.columns)


def pair_names(pairs: DataFrame) -> DataFrame:
    """prot_id: every name that pairs (prot1, prot2) hold, once."""
    return pairs.select(F.col("prot1").alias("prot_id")).union(pairs.select("prot2")).distinct()


def gathered(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames of equal columns; a row that several hold stays as often."""
    out, *rest = frames
    for x in rest:
        out = out.unionByName(x)
    return out


def merged_sets(rows: DataFrame, key: str, value: str, *conditions: Column) -> DataFrame:
    """key, merged: the sorted union of the sets of values that meet each condition; empty where none does."""
    sets = [F.collect_set(F.when(c, F.col(value))) for c in conditions]
    d = rows.groupBy(key).agg(*[x.alias(f"__s{i}") for i, x in enumerate(sets)])
    return d.select(key, F.array_sort(F.array_distinct(F.flatten(F.array(*[f"__s{i}" for i in range(len(sets))])))).alias("merged"))


def with_given(computed: DataFrame, given: DataFrame) -> DataFrame:
    """pair, given, computed, for pairs that have both."""
    return given.select("pair", "given").join(computed.select("pair", "computed"), "pair")


def methods_compared(rows: DataFrame, a: str, b: str) -> DataFrame:
    """pair, a, b and diff of values (pair, method, value), for pairs that both methods have."""
    d = rows.filter(F.col("method").isin(a, b)).groupBy("pair").pivot("method", [a, b]).agg(F.sum("value"))
    return d.toDF("pair", "a", "b").filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def permuted(counts: DataFrame, order: DataFrame) -> DataFrame:
    """A matrix (a, b, n) with its letters renamed by order (old, new), an alphabet's table."""
    one, two = F.broadcast(order.toDF("a", "__a")), F.broadcast(order.toDF("b", "__b"))
    return counts.join(one, "a").join(two, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "n")


def chunks(names: DataFrame, order: str, size: int = 10, group: str | None = None) -> DataFrame:
    """names with chunk: `size` names each, in order (within the group, else of all names: a name list)."""
    d = placed_within(names, [group], order) if group else placed(names, order)
    return d.withColumn("chunk", F.floor(F.col("place") / size).cast("int")).drop("place")


def length_order(proteins: DataFrame) -> DataFrame:
    """Proteins (prot_id, len) with their place (from 1) in the order of length, then name."""
    return placed(proteins, "len", "prot_id").withColumn("place", (F.col("place") + 1).cast("int"))


def neighbours(residues: DataFrame, most: Column, apart: int = 5) -> DataFrame:
    """prot_id, pos, nbr_pos of residues of a protein closer than `most` (an expression on a and b) and over `apart` places apart."""
    a = residues.select("prot_id", F.col("pos"), F.col("at").alias("a"))
    b = residues.select("prot_id", F.col("pos").alias("nbr_pos"), F.col("at").alias("b"))
    return a.join(b, "prot_id").filter((F.abs(F.col("pos") - F.col("nbr_pos")) > apart) & most).select("prot_id", "pos", "nbr_pos")


def near_values(residues: DataFrame, radius: float, apart: int = 5) -> DataFrame:
    """prot_id, pos, nbr_pos of residues (prot_id, pos, at) whose values differ by less than radius and that are over `apart` places apart.

    Values are dealt to cells as wide as the radius, and each is compared with its own cell and those beside it, not with all of its protein.
    """
    a = residues.select("prot_id", "pos", F.col("at").alias("a"), F.explode(F.array(*[F.floor(F.col("at") / radius) + i for i in (-1, 0, 1)])).alias("cell"))
    b = residues.select("prot_id", F.col("pos").alias("nbr_pos"), F.col("at").alias("b"), F.floor(F.col("at") / radius).alias("cell"))
    return a.join(b, ["prot_id", "cell"]).filter((F.abs(F.col("pos") - F.col("nbr_pos")) > apart) & (F.abs(F.col("a") - F.col("b")) < radius)).select("prot_id", "pos", "nbr_pos")


def cell_neighbours(points: DataFrame, radius: float, apart: int = 5) -> DataFrame:
    """prot_id, pos, nbr_pos of points (x, y, z) closer than radius: each is compared with the 27 cells around it."""
    cell = [F.floor(F.col(k) / radius) for k in "xyz"]
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = points.select("prot_id", "pos", "x", "y", "z", *[c.alias(f"c{k}") for c, k in zip(cell, "xyz", strict=True)])
    for k in "xyz":
        a = a.withColumn("d", F.explode(near)).withColumn(f"c{k}", F.col(f"c{k}") + F.col("d")).drop("d")
    b = points.select("prot_id", F.col("pos").alias("nbr_pos"), *[F.col(k).alias(f"n{k}") for k in "xyz"], *[c.alias(f"c{k}") for c, k in zip(cell, "xyz", strict=True)])
    d2 = sum((F.col(k) - F.col(f"n{k}")) ** 2 for k in "xyz")
    return a.join(b, ["prot_id", "cx", "cy", "cz"]).filter((d2 < radius**2) & (F.abs(F.col("pos") - F.col("nbr_pos")) > apart)).select("prot_id", "pos", "nbr_pos")


def aligned_edges(edges1: DataFrame, edges2: DataFrame, aligned: DataFrame) -> DataFrame:
    """pair, i, k, bin1, bin2: edges of the first protein against those of the second under an alignment.

    edges have pair, pos, nbr_pos, bin; aligned has pair, i, j. An edge without partner has a null bin.
    """
    at = lambda a, b: aligned.select("pair", F.col("i").alias(a), F.col("j").alias(b))
    one = edges1.select("pair", F.col("pos").alias("i"), F.col("nbr_pos").alias("k"), F.col("bin").alias("bin1"))
    one = one.join(at("i", "i2"), ["pair", "i"]).join(at("k", "k2"), ["pair", "k"]).select("pair", "i", "k", "bin1")
    two = edges2.select("pair", F.col("pos").alias("i2"), F.col("nbr_pos").alias("k2"), F.col("bin").alias("bin2"))
    two = two.join(at("i", "i2"), ["pair", "i2"]).join(at("k", "k2"), ["pair", "k2"]).select("pair", "i", "k", "bin2")
    return one.join(two, ["pair", "i", "k"], "full_outer")


#: References that a task pairs with queries. So few are a byte each in a columnar file, and their sequence, repeated for each query, is whole bytes.
REFERENCE_ROWS = 240


def all_against_all(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Every query with every reference, the query itself included: the query list is the small, stated side.

    A task takes a query after another through the same few references. In a columnar file a query is then one run, and the references
    repeat themselves, so that it takes far less than a bit for each number of a pair that it would take in another order.
    """
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-refs.count() // REFERENCE_ROWS) or 1
    asked = queries.repartition(-(-tasks // parts))
    return asked.hint("shuffle_replicate_nl").crossJoin(refs.repartition(parts))


def segments(cells: DataFrame) -> DataFrame:
    """name, i, j, segment: a new segment begins where the previous diagonal cell is empty."""
    w = W.partitionBy("name").orderBy("i", "j")
    fresh = F.coalesce((F.lag("i").over(w) != F.col("i") - 1) | (F.lag("j").over(w) != F.col("j") - 1), F.lit(True))
    return cells.withColumn("new", fresh.cast("int")).withColumn("segment", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("new")


def spans(cells: DataFrame) -> DataFrame:
    return cells.groupBy("name").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.count("*").alias("matches"))


def hashed_sample(rows: DataFrame, hashed: Column, n: int, key: str) -> DataFrame:
    """n rows without replacement, in the order of a hash: the same rows on every run."""
    return rows.withColumn("__h", hashed).orderBy("__h", key).limit(n).drop("__h")


def resampled(rows: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """A seeded sample with replacement: each row comes as often as a Poisson variable of mean `share` that a hash of its key decides.

    The first eight hex digits of md5("seed:key") are the row's place in [0, 1), and the number of copies is how many values of the
    distribution function it has passed. So any engine, and any split of the rows, gives the same sample. Rows of an equal key come alike often; a null key counts as empty.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2.0**32
    times = sum(((place >= p).cast("int") for p in poisson_steps(share)), F.lit(0))
    return rows.withColumn("__n", times).filter("__n > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")


def poisson_steps(mean: float) -> list[float]:
    """Values of the Poisson distribution function, as far as 32 bits tell them from 1."""
    out, term = [], math.exp(-mean)
    total, k = term, 0
    while total < 1 - 2.0**-33:
        out.append(total)
        k += 1
        term *= mean / k
        total += term
    return out


def best_centre(vectors: DataFrame, centres: DataFrame, similarity: Column, ties: bool = False) -> DataFrame:
    """id, centre_id, sim of the most similar centre (least centre_id of equals; all of them with ties).

    centres is a codebook of fixed size; similarity is an expression on vec and centre.
    """
    d = vectors.crossJoin(F.broadcast(centres)).select("id", "centre_id", similarity.alias("sim"))
    if ties:
        top = d.groupBy("id").agg(F.max("sim").alias("top"))
        return d.join(top, "id").filter("sim = top").select("id", "centre_id", "sim")
    got = F.max_by(F.struct("centre_id", "sim"), F.struct("sim", -F.col("centre_id"))).alias("x")
    return d.groupBy("id").agg(got).select("id", "x.*")
