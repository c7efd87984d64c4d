"""Numbers of near rows without pairs, against pairs one by one: ties on both sides, a hot value, few rows a batch, odd values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.operators import nearness as ne
from motifgrid.operators import ranking as rk


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def made(spark, folds, values, n=150, seed=3):
    r = random.Random(seed)
    rows = [(i, f"a.{r.choice([0] * 6 + list(range(folds)))}.{r.randrange(2)}.{r.randrange(2)}", r.choice(values)) for i in range(n)]
    return spark.createDataFrame(rows, "prot_id long, fam string, value double").repartition(3).cache()


def hits_of(p, q):
    hits = q.select(F.col("prot_id").alias("query"), F.col("value").alias("v")).crossJoin(p.select(F.col("prot_id").alias("target"), "value"))
    return hits.select("query", "target", F.abs(F.col("value") - F.col("v")).alias("gap"))


VALUES = [x / 100 for x in range(-900, 900, 50)] + [0.0, -0.0, 0.1, 0.2, 0.30000000000000004] + [4.5] * 30


@pytest.mark.parametrize("folds", [4, 1])
def test_first_false_positives_need_no_pairs(spark, monkeypatch, small_batches, folds):
    p = made(spark, folds, VALUES)
    q = p.filter("prot_id % 3 = 0")
    monkeypatch.setattr(rk, "gaps", None)  # what makes pairs
    got = rk.first_false_positive_by_gap(p, q).collect()
    assert sorted(got) == sorted(rk.first_false_positive(hits_of(p, q), p, F.struct("gap", "target")).collect()) and len(got) > (40 if folds > 1 else -1)


def test_curves_need_no_pairs(spark, monkeypatch, small_batches):
    p = made(spark, 4, VALUES)
    q, thresholds = p.filter("prot_id % 3 = 0"), [15.0, 1.0, 18.5, 19.9, 20.0, -3.0]
    monkeypatch.setattr(rk, "gaps", None)
    got = rk.precision_recall_by_gap(p, q, lambda gap: 20 - gap, thresholds, 2.0).collect()
    want = rk.precision_recall(hits_of(p, q).withColumn("score", 20 - F.col("gap")), p, thresholds, 2.0).collect()
    assert len(got) == 6 and np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)))


def test_odd_values_are_paired(spark):
    """Nulls, numbers that aren't finite, and values that differ by less than their gaps are rounded."""
    for odd in (None, float("nan"), float("inf")):
        p = made(spark, 4, [1.0, 2.5, 7.0, odd], 60)
        q = p.filter("prot_id % 3 = 0")
        got = rk.precision_recall_by_gap(p, q, lambda gap: 20 - gap, [15.0, 19.0]).collect()
        want = rk.precision_recall(hits_of(p, q).withColumn("score", 20 - F.col("gap")), p, [15.0, 19.0]).collect()
        assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)))
    p = made(spark, 4, [1e17, 1.0, 1.0 + 2**-52, 2.0, 3.0], 60)
    q = p.filter("prot_id % 3 = 0")
    assert sorted(rk.first_false_positive_by_gap(p, q).collect()) == sorted(rk.first_false_positive(hits_of(p, q), p, F.struct("gap", "target")).collect())


def test_ends_are_the_furthest_doubles():
    r = np.random.default_rng(4)
    q = np.concatenate([r.normal(0, 1000, 200).round(2), [0.0, -0.0, 5.0, -5.0, 1e-300, 1e300]])
    for gap in (0.0, 5.0, 0.1, 1e-9, 123.45):
        end = ne.upper_ends(q, np.full(len(q), gap))
        assert (end - q <= gap).all() and (np.nextafter(end, np.inf) - q > gap).all()
    assert np.isinf(ne.upper_ends(q, np.full(len(q), np.inf))).all()
    for t in (10, 97, 0.1, 100):
        g = ne.largest_gap(lambda x: 100 - x / 100 > t)
        assert g < 0 if t == 100 else 100 - g / 100 > t >= 100 - np.nextafter(g, np.inf) / 100
