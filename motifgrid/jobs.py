"""Jobs: what a user runs from files to files. `python -m motifgrid JOB --help` lists the options of each.

Letters are Parquet (prot_id, letters: array<int>) or .npz files with an array a protein; coordinates are Parquet (prot_id,
ca: array<struct<x, y, z>>) or .npz with three columns; count vectors are Parquet (prot_id, vectors: array<array<double>>, the place off the map
last). Pairs are the alignment table that `files.alignments` reads, name lists and hits as `files.names` and `files.hits` have them.
Matrices are CSV with a header (a, b, score), parameters CSV (alphabet, lam, k). One Spark job takes all of a query list, so none is split into batches
by hand: pairs are dealt to tasks, and a task aligns pairs of like length together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequences import path_label
from .operators import alignment as al
from .operators import counts as ct
from .operators import learning as le
from .operators import ranking as rk
from .operators import relations as rl
from .sources import files
from .sources.shared import written

#: Gap costs of the usual grid: 10 openings by 7 extensions.
OPENS, EXTENDS = tuple(float(x) for x in range(-20, 0, 2)), tuple(-x / 2 for x in range(7))


def letters_of(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, letters (array<int>)."""
    if path.rstrip("/").endswith(".npz"):
        return files.arrays(spark, path).select("prot_id", F.transform("data", lambda x: x.cast("int")).alias("letters"))
    return spark.read.parquet(path).select("prot_id", F.col("letters").cast("array<int>").alias("letters"))


def coordinates_of(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, coords (array<struct<x, y, z>>)."""
    if path.rstrip("/").endswith(".npz"):
        at = lambda i: F.struct(*[F.get("data", 3 * i + k).alias(x) for k, x in enumerate("xyz")])
        return files.arrays(spark, path).filter("cols = 3 and rows > 0").select("prot_id", F.transform(F.sequence(F.lit(0), F.col("rows") - 1), at).alias("coords"))
    return spark.read.parquet(path).select("prot_id", F.col("ca").alias("coords"))


def placed_letters(letters: DataFrame) -> DataFrame:
    """prot_id, pos, letter."""
    return letters.select("prot_id", F.posexplode("letters").alias("pos", "letter"))


def matrix_in(spark: SparkSession, path: str) -> np.ndarray:
    """A square matrix of an alphabet, or of bins."""
    rows = spark.read.schema("a int, b int, score double").option("header", "true").csv(path)
    return le.matrix_of(rows, 1 + rows.agg(F.max(F.greatest("a", "b"))).first()[0])


def saved(rows: DataFrame, path: str, sep: str = ",") -> None:
    """One CSV file with a header: a table of alphabet, parameter or query size."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def matrix(spark: SparkSession, letters: str, pairs: str, out: str, size: int = 20) -> None:
    """Substitution scores of an alphabet from aligned pairs; pairs with an excluded name or an unknown protein are left out."""
    known = letters_of(spark, letters)
    aligned = files.alignments(spark, pairs).filter(~F.col("prot1").isin(*rl.BAD_NAMES) & ~F.col("prot2").isin(*rl.BAD_NAMES))
    aligned = rl.pairs_with(aligned, known)
    saved(ct.substitution_scores(ct.pair_counts(ct.exploded_pairs(aligned, placed_letters(known))), size), out)


def karlin(spark: SparkSession, letters: str, matrix: str, names: str, out: str) -> None:
    """lambda and K of a matrix, over the letters of the named proteins."""
    known = letters_of(spark, letters).join(files.names(spark, names).distinct(), "prot_id", "left_semi")
    back = ct.background(placed_letters(known))
    scores = spark.read.schema("a int, b int, score double").option("header", "true").csv(matrix).withColumn("score", F.col("score").cast("int"))
    found = al.karlin_parameters(ct.score_distribution(back, scores).withColumn("alphabet", path_label(F.lit(letters))))
    saved(found, out)


def _proteins(spark: SparkSession, coordinates: str, letters: Sequence[str], vectors: str | None) -> DataFrame:
    """prot_id, letters (a list of alphabets, or count vectors), coords."""
    d = coordinates_of(spark, coordinates)
    if vectors:
        return d.join(spark.read.parquet(vectors).select("prot_id", F.col("vectors").alias("letters")), "prot_id")
    for i, path in enumerate(letters):
        d = d.join(letters_of(spark, path).select("prot_id", F.col("letters").alias(f"__{i}")), "prot_id")
    return d.select("prot_id", F.array(*[f"__{i}" for i in range(len(letters))]).alias("letters"), "coords")


def _options(spark: SparkSession, letters: Sequence[str], vectors: str | None, matrices: Sequence[str], jaccard_scores: str | None) -> tuple[list[np.ndarray], np.ndarray | None]:
    if bool(vectors) == bool(letters) or bool(vectors) != bool(jaccard_scores) or len(matrices) != max(1, len(letters)):
        raise ValueError("one matrix for each alphabet, or count vectors with one transition matrix and a list of scores")
    scores = None
    if jaccard_scores:
        held = spark.read.schema("bin int, score double").option("header", "true").csv(jaccard_scores).orderBy("bin").collect()  # one a bin
        scores = np.array([r.score for r in held])
    return [matrix_in(spark, m) for m in matrices], scores


def search(
    spark: SparkSession, coordinates: str, queries: str, refs: str, out: str, letters: Sequence[str] = (), matrices: Sequence[str] = (), vectors: str | None = None, jaccard_scores: str | None = None,
    lam: Sequence[float] = (), k: Sequence[float] = (), weights: Sequence[float] = (), gap_open: float = al.OPEN, gap_extend: float = al.EXTEND, query_list: str = "queries",
) -> None:
    """Every named query against every named reference; hits are appended to `out` in the order of rank, a folder for each query list."""
    held, scores = _options(spark, letters, vectors, matrices, jaccard_scores)
    n = len(held)
    if any(len(x) not in (0, n) for x in (lam, k, weights)):
        raise ValueError("one lambda, K and weight for each alphabet")
    proteins = _proteins(spark, coordinates, letters, vectors)
    asked, against = (files.names(spark, x).distinct() for x in (queries, refs))
    proteins = proteins.join(asked.unionByName(against).distinct(), "prot_id", "left_semi")
    pairs = rl.all_against_all(asked.select(F.col("prot_id").alias("prot1")), against.select(F.col("prot_id").alias("prot2")))
    options = {"weights": list(weights) or None, "karlins": list(zip(lam, k, strict=True)) or None, "open_": gap_open, "extend": gap_extend, "scores": scores}
    hits = al.align_pairs(al.with_proteins(pairs, proteins), held, **options).withColumnsRenamed({"prot1": "query", "prot2": "target"})
    files.append_hits(rk.ranked(hits, F.desc("lddt"), F.col("target")).withColumn("query_list", F.lit(query_list)), out)


def gap_grid(
    spark: SparkSession, coordinates: str, pairs: str, given: str, out: str, letters: Sequence[str] = (), matrices: Sequence[str] = (), vectors: str | None = None, jaccard_scores: str | None = None,
    weightings: Sequence[Sequence[float]] = (), opens: Sequence[float] = OPENS, extends: Sequence[float] = EXTENDS,
) -> None:
    """LDDT of all listed pairs for each choice of gap costs and weights: its mean, median and deviation, and its rank correlation with the given LDDT.

    Writes `out`/values (a row a pair and choice), `out`/choices and `out`/best (the choice with the largest value of each measure).
    """
    held, scores = _options(spark, letters, vectors, matrices, jaccard_scores)
    proteins = _proteins(spark, coordinates, letters, vectors)
    asked = rl.pairs_with(files.alignments(spark, pairs).select("prot1", "prot2"), proteins)
    found = al.grid_search(al.with_proteins(asked, proteins), held, list(opens), list(extends), [list(w) for w in weightings] or None, scores)
    found = found.join(files.given_scores(spark, given).withColumnRenamed("lddt", "given"), ["prot1", "prot2"])
    found.write.mode("overwrite").parquet(f"{out}/values")
    found, choice = spark.read.parquet(f"{out}/values"), ["weighting", "open", "extend"]
    measures = written(rk.metrics(found, choice, "lddt").join(rk.spearman(found, choice, "lddt", "given"), choice), "grid")
    saved(measures, f"{out}/choices")
    saved(rk.best_of(measures, ["mean", "median", "rho"], *choice), f"{out}/best")


def alphabet(spark: SparkSession, letters: str, coordinates: str, train_pairs: str, train_names: str, pairs: str, given: str, out: str, size: int = 20) -> None:
    """All that a new alphabet needs: its matrix, lambda and K, and the grid of gap costs."""
    matrix(spark, letters, train_pairs, f"{out}/matrix", size)
    karlin(spark, letters, f"{out}/matrix", train_names, f"{out}/karlin")
    gap_grid(spark, coordinates, pairs, given, f"{out}/grid", [letters], [f"{out}/matrix"])


def evaluate(spark: SparkSession, hits: str, classes: str, out: str, eligible: int, refs: int, by: str = "lddt") -> None:
    """Sensitivity up to the first false positive of each query, and its averages scaled to `eligible` queries of `refs` hits each.

    Writes `out`/queries (tab-separated, with the header NAME SCOP FAM ...) and `out`/averages.
    """
    held = files.hits(spark, hits)
    found = rk.first_false_positive(held, files.classes(spark, classes), F.struct((-F.col(by)).alias("best"), "target"))
    names = ["NAME", "SCOP", "FAM", "SFAM", "FOLD", "FP", "FAMCNT", "SFAMCNT", "FOLDCNT"]
    found = written(found.toDF(*names), "evaluation")
    saved(found.orderBy("NAME"), f"{out}/queries", "\t")
    lines = held.count()
    averages = [rk.scaled_average(found, c, eligible, refs, lines).first()[0] for c in names[2:5]] if lines else [None] * 3
    saved(spark.createDataFrame([(lines / refs, *averages)], "queries double, fam double, sfam double, fold double"), f"{out}/averages")


def train(spark: SparkSession, pairs: str, validation: str, out: str, codes: int = 20, epochs: int = 8, seed: int = 68) -> None:
    """A codebook from training pairs (x, y in Parquet): `out`/codebook (one row, its numbers) and `out`/history (an epoch a row)."""
    held = [spark.read.parquet(p).select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y")) for p in (pairs, validation)]
    book, history = le.trained_codebook(held[0], codes=codes, epochs=epochs, validation=held[1], seed=seed)
    (dims, hidden), (n, latent) = book.weights["w1"].shape, book.weights["codes"].shape
    spec = "dims int, hidden int, latent int, codes int, steps long, numbers array<double>"
    spark.createDataFrame([(dims, hidden, latent, n, book.steps, [float(x) for x in book.packed()])], spec).write.mode("overwrite").parquet(f"{out}/codebook")
    rows = [(i, x["loss"], x["validation_loss"], x["perplexity"]) for i, x in enumerate(history)]
    saved(spark.createDataFrame(rows, "epoch int, loss double, validation_loss double, perplexity double"), f"{out}/history")


def encode(spark: SparkSession, codebook: str, vectors: str, out: str) -> None:
    """Letters (prot_id, letters) of count vectors (prot_id, vectors; the place off the map is left out)."""
    r = spark.read.parquet(codebook).first()
    book = le.Codebook(r.dims, r.hidden, r.latent, r.codes).unpacked(np.array(r.numbers), r.steps)
    d = spark.read.parquet(vectors).select("prot_id", F.posexplode("vectors").alias("pos", "vec"))
    d = d.select(F.struct("prot_id", "pos").alias("id"), F.slice("vec", 1, r.dims).cast("array<double>").alias("vec"))
    letters = F.sort_array(F.collect_list(F.struct("id.pos", F.col("code").cast("int").alias("code"))))
    found = le.encoded(d, book).groupBy("id.prot_id").agg(F.transform(letters, lambda x: x["code"]).alias("letters"))  # a protein's residues
    found.write.mode("overwrite").parquet(out)


JOBS = {f.__name__: f for f in (matrix, karlin, search, gap_grid, alphabet, evaluate, train, encode)}
