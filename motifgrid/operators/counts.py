"""Counts of letters, pairs and bins, and the scores derived from them.

Counting is a groupBy with partial sums; what follows works on tables no larger than the square of
an alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def everything():
    """A window over all rows, for tables of alphabet size only."""
    return W.partitionBy()


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n of aligned letters (a, b)."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def exploded_pairs(alignments: DataFrame, letters: DataFrame) -> DataFrame:
    """a, b at the aligned places of (prot1, prot2, aln); letters has prot_id, pos and letter."""
    cells = alignments.select("prot1", "prot2", F.posexplode("aln").alias("i", "j")).filter("j >= 0")
    one = letters.select(F.col("prot_id").alias("prot1"), F.col("pos").alias("i"), F.col("letter").alias("a"))
    two = letters.select(F.col("prot_id").alias("prot2"), F.col("pos").alias("j"), F.col("letter").alias("b"))
    return cells.join(one, ["prot1", "i"]).join(two, ["prot2", "j"]).select("a", "b")


def grid(counts: DataFrame, size: int) -> DataFrame:
    """All (a, b) of an alphabet with n, t (n of (b, a)), s_a and s_b (row and column sum) and total."""
    one = counts.sparkSession.range(size).select(F.col("id").cast("int").alias("a"))
    dense = one.crossJoin(one.withColumnRenamed("a", "b"))  # size squared rows
    full = dense.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return _with_margins(full)


def _with_margins(full: DataFrame) -> DataFrame:
    turned = full.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("t"))
    full = full.join(turned, ["a", "b"])
    by_a, by_b = W.partitionBy("a"), W.partitionBy("b")
    full = full.withColumn("s_a", F.sum(F.col("n") + F.col("t")).over(by_a)).withColumn("s_b", F.sum(F.col("n") + F.col("t")).over(by_b))
    return full.withColumn("total", F.sum("n").over(everything()))


def _ratio() -> tuple[Column, Column]:
    both = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("n") + F.col("t")).cast("double")
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    return both, 4.0 * both * F.col("total") / (twice * F.col("s_a") * F.col("s_b"))


def substitution_scores(counts: DataFrame, size: int) -> DataFrame:
    """a, b, score: twice the log2 odds, rounded half to even; cells without pairs get the least score (0 at most)."""
    both, ratio = _ratio()
    raw = F.when(both > 0, F.bround(2.0 * F.log2(F.when(both > 0, ratio))))
    d = grid(counts, size).withColumn("raw", raw)
    return d.select("a", "b", F.coalesce("raw", F.min(F.coalesce("raw", F.lit(0.0))).over(everything())).cast("int").alias("score"))


def mutual_information(counts: DataFrame, size: int) -> DataFrame:
    """mi in bits over ordered pairs, one pseudo-count a cell."""
    both, ratio = _ratio()
    d = _with_margins(grid(counts, size).select("a", "b", (F.col("n") + 1).alias("n")))
    return d.agg(F.sum(both / F.col("total") * F.log2(ratio)).alias("mi"))


def negative_entropy(counts: DataFrame, size: int) -> DataFrame:
    """Sum of p ln p over letters, one pseudo-count a cell."""
    d = grid(counts, size).select("a", "b", (F.col("n") + 1).alias("n"))
    ends = d.select(F.explode(F.array("a", "b")).alias("letter"), "n").groupBy("letter").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(everything())
    return ends.select((p * F.ln(p)).alias("x")).agg(F.sum("x").alias("neg_entropy"))


def joint_information(joint: DataFrame) -> DataFrame:
    """mi in nats of a joint probability table (a, b, p)."""
    d = joint.filter("p > 0").withColumn("pa", F.sum("p").over(W.partitionBy("a"))).withColumn("pb", F.sum("p").over(W.partitionBy("b")))
    return d.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))


def unordered(pairs: DataFrame) -> DataFrame:
    """a <= b, n, p and half (p, halved off the diagonal)."""
    d = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    d = d.withColumn("p", F.col("n") / F.sum("n").over(everything()))
    return d.withColumn("half", F.when(F.col("a") == F.col("b"), F.col("p")).otherwise(F.col("p") / 2))


def unordered_scores(pairs: DataFrame, size: int) -> DataFrame:
    """a <= b, score: twice the log2 odds, rounded half to even, -10 where undefined."""
    d = unordered(pairs)
    singles = d.select(F.explode(F.array("a", "b")).alias("letter"), "n").groupBy("letter").agg(F.sum("n").alias("m")).withColumn("q", F.col("m") / F.sum("m").over(everything())).select("letter", "q")
    one = pairs.sparkSession.range(size).select(F.col("id").cast("int").alias("a"))
    full = one.crossJoin(one.withColumnRenamed("a", "b")).filter("a <= b").join(d.select("a", "b", "p"), ["a", "b"], "left")
    full = full.join(singles.select(F.col("letter").alias("a"), F.col("q").alias("qa")), "a", "left").join(singles.select(F.col("letter").alias("b"), F.col("q").alias("qb")), "b", "left")
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    odds = F.try_divide(F.col("p"), F.col("qa") * F.col("qb") * twice)
    return full.select("a", "b", F.coalesce(F.when(odds > 0, F.bround(2.0 * F.ln(odds) / F.ln(F.lit(2.0)))), F.lit(-10.0)).cast("int").alias("score"))


def cross_log_odds(counts: DataFrame) -> DataFrame:
    """a, b, n, log_odds (ln, -10 where n is 0) and of_b (share of b's count) between two alphabets."""
    row, column, all_ = F.sum("n").over(W.partitionBy("a")), F.sum("n").over(W.partitionBy("b")), F.sum("n").over(everything())
    odds = F.when(F.col("n") > 0, F.ln(F.col("n").cast("double") * all_ / (row * column))).otherwise(-10.0)
    return counts.select("a", "b", "n", odds.alias("log_odds"), F.try_divide(F.col("n").cast("double"), column).alias("of_b"))


def edge_bins(edges: DataFrame, off: int) -> tuple[DataFrame, DataFrame]:
    """Frequencies of unordered bin pairs and of single bins; edges has bin1 and bin2, null if off the map."""
    d = edges.select(F.coalesce("bin1", F.lit(off)).alias("x"), F.coalesce("bin2", F.lit(off)).alias("y")).filter(f"not (x = {off} and y = {off})")
    pairs = d.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
    singles = pairs.select(F.explode(F.array("a", "b")).alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    p = lambda d: d.withColumn("p", F.col("n") / F.sum("n").over(everything()))  # noqa: E731  one row a bin or pair of bins
    return p(pairs), p(singles)


def transitions(pairs: DataFrame) -> DataFrame:
    """a, b, p of the row-stochastic matrix of unordered frequencies (a, b, p)."""
    half = pairs.select(F.explode(F.expr("array(struct(a, b, p / 2 as f), struct(b as a, a as b, p / 2 as f))")).alias("x")).select("x.*")
    f = half.groupBy("a", "b").agg(F.sum("f").alias("f"))
    return f.select("a", "b", F.try_divide("f", F.sum("f").over(W.partitionBy("a"))).alias("p"))


def background(letters: DataFrame) -> DataFrame:
    """letter, n, p."""
    d = letters.groupBy("letter").agg(F.count("*").alias("n"))
    return d.withColumn("p", F.col("n") / F.sum("n").over(everything()))


def score_distribution(back: DataFrame, matrix: DataFrame) -> DataFrame:
    """score, p on the dense range of scores."""
    a = back.select(F.col("letter").alias("a"), F.col("p").alias("pa"))
    b = back.select(F.col("letter").alias("b"), F.col("p").alias("pb"))
    d = matrix.join(a, "a").join(b, "b").groupBy("score").agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))
    span = d.agg(F.explode(F.sequence(F.min("score"), F.max("score"))).alias("score"))
    return span.join(d, "score", "left").select("score", F.coalesce("p", F.lit(0.0)).alias("p"))


def sizes(rows: DataFrame, key: str) -> DataFrame:
    """key, n."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, bins: int = 100) -> DataFrame:
    """bin, n of x in [0, 1]."""
    return values.groupBy(F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Bins of the repaired score curve, and what its top lies above its anchor.
FLAT, RISE, TOP, LIFT = 8, 25, 75, 0.5


def repaired_scores(aligned: DataFrame, whole: DataFrame) -> DataFrame:
    """bin, raw (twice the ln of aligned / all pairs / overall share) and score, flat below and above, linear where it is noisy."""
    d = whole.select("bin", F.col("n").alias("all_n")).join(aligned.select("bin", "n"), "bin", "left")
    share = F.sum("n").over(everything()) / F.sum("all_n").over(everything())
    d = d.select("bin", (2.0 * F.ln(F.col("n") / F.col("all_n") / share)).alias("raw"))
    at = lambda b: F.max(F.when(F.col("bin") == b, F.col("raw"))).over(everything())
    low, mid, top = at(FLAT), at(RISE), at(TOP)
    line = (F.col("bin") - FLAT) / float(RISE - FLAT) * (mid - low) + low
    curve = F.when(F.col("bin") < FLAT, low).when(F.col("bin") < RISE, line).when(F.col("bin") < TOP, F.col("raw")).otherwise(top + LIFT)
    return d.select("bin", "raw", F.bround(curve).cast("int").alias("score"))


def angle_histogram(residues: DataFrame, n: int = 30) -> DataFrame:
    """phi_bin, psi_bin, shares among all, PRO and GLY, and whether any exceeds 1 / n^2."""
    d = residues.groupBy("phi_bin", "psi_bin").agg(F.count("*").alias("n"), F.count_if(F.col("resname") == "PRO").alias("n_pro"), F.count_if(F.col("resname") == "GLY").alias("n_gly"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(everything())), F.lit(0.0))
    d = d.select("phi_bin", "psi_bin", "n", share("n").alias("f"), share("n_pro").alias("f_pro"), share("n_gly").alias("f_gly"))
    return d.withColumn("frequent", F.greatest("f", "f_pro", "f_gly") > 1.0 / n**2)


def bin_counts(edges: DataFrame) -> DataFrame:
    """prot_id, pos, bin_id, cnt of neighbour edges."""
    return edges.groupBy("prot_id", "pos", "bin_id").agg(F.count("*").alias("cnt"))


def dense_bins(counts: DataFrame, bins: int, last: int = 5) -> DataFrame:
    """prot_id, pos and the count vector of `bins` places, with the constant last place."""
    held = counts.groupBy("prot_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("bin_id", "cnt"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return held.select("prot_id", "pos", F.concat(vec, F.array(F.lit(last).cast("long"))).alias("vec"))


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """name, jaccard of two sets of alignment cells (name, i, j)."""
    both = one.join(two, ["name", "i", "j"]).groupBy("name").agg(F.count("*").alias("both"))
    n = one.groupBy("name").agg(F.count("*").alias("n1")).join(two.groupBy("name").agg(F.count("*").alias("n2")), "name", "full_outer").join(both, "name", "left")
    inter = F.coalesce("both", F.lit(0))
    return n.select("name", F.try_divide(inter.cast("double"), F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)) - inter).alias("jaccard"))
