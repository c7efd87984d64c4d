"""Column expressions on array<double> vectors and on similarity values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; null where all are zero."""
    low = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    high = total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.try_divide(low, high)


def similarity_bin(j: Column, bins: int = 100) -> Column:
    """Bin of a similarity in [0, 1]: half-open, the last one closed."""
    return F.least(F.floor(j * bins), F.lit(bins - 1)).cast("int")


def similarity_score(j: Column, scores: Column) -> Column:
    """Score of the bin (low, high] that holds j; exactly 0 has a score of 0."""
    return F.when(j <= 0, F.lit(0)).otherwise(F.element_at(scores, F.greatest(F.ceil(j * F.size(scores)), F.lit(1)).cast("int")))


def without_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - 1)


def bit_score(score: Column, lam: Column, k: Column) -> Column:
    return (lam * score - F.ln(k)) / F.ln(F.lit(2.0))
