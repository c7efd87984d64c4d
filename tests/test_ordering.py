"""Places, medians and discordant pairs against plain versions, with ties, nulls and a hot group."""

import random
import statistics
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from motifgrid.operators import ordering as od
from motifgrid.operators import ranking as rk
from motifgrid.operators import relations as rl


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_places(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["hot"] * 5 + ["a", None]), r.choice([1.5, 2.5, None])) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    low = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first
    order = sorted(rows, key=lambda x: (low(x[2]), x[0]))
    assert {x.id: x.place for x in od.placed(d, "v", "id").collect()} == {x[0]: i for i, x in enumerate(order)}
    by = defaultdict(list)
    for x in order:
        by[x[1]].append(x[0])
    got = od.placed_within(d, ["g"], "v", F.col("id")).collect()
    assert {x.id: x.place for x in got} == {i: k for ids in by.values() for k, i in enumerate(ids)}
    assert {x.id: x.chunk for x in rl.chunks(d, "id", 7).collect()} == {i: i // 7 for i in range(300)}
    assert od.placed(d.filter("false"), "v").count() == 0


def test_medians(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.choice([None, 1.0, -0.0, r.gauss(0, 1), 1e300])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    d = spark.createDataFrame(rows, "g string, v double").repartition(4)
    assert {x.g: x.median for x in od.exact_medians(d, ["g"], "v").collect()} == {g: statistics.median(v) for g, v in by.items()}
    got = {x.g: x for x in rk.metrics(d, ["g"], "v").collect()}
    assert set(got) == {g for g, _ in rows} and got["none"].median is None and got["one"].median == 4.0
    assert "percentile" not in plan_of(rk.metrics(d, ["g"], "v")).lower()


def test_inversions():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 200):
        for top in (1, 3, 1000):
            v = r.integers(0, top, n)
            assert od.inversions(v) == sum(int((v[i] > v[i + 1 :]).sum()) for i in range(n))


def test_concordance(spark, monkeypatch):
    r = random.Random(4)
    sign = lambda x: (x > 0) - (x < 0)
    for n, size in ((0, 10), (1, 10), (2, 10), (260, 10), (260, 1 << 12)):
        rows = [(i, r.choice([None, 1.0, 1.0, 2.0, r.random()]), r.choice([3, 3, 3, r.randrange(50)])) for i in range(n)]
        full = [x for x in rows if x[1] is not None]
        same = [sign(a[1] - b[1]) == sign(a[2] - b[2]) for i, a in enumerate(full) for b in full[i + 1 :]]
        monkeypatch.setattr(od, "LEAST_BLOCK", size)
        got = rk.concordance(spark.createDataFrame(rows, "id long, x double, y long").repartition(3)).first().share
        assert (got is None and not same) or abs(got - sum(same) / len(same)) < 1e-12


def test_first_false_positive_needs_no_ranks(spark):
    """A struct that orders the hits gives what their ranks give."""
    r = random.Random(5)
    classes = spark.createDataFrame([(i, f"a.{i % 3}.{i % 6}.{i % 12}") for i in range(60)], "prot_id long, fam string")
    hits = spark.createDataFrame([(q, t, float(r.randrange(6))) for q in range(0, 60, 7) for t in range(62)], "query long, target long, gap double")
    ranks = rk.ranked(hits, F.col("gap"), F.col("target"))
    one, two = rk.first_false_positive(ranks, classes), rk.first_false_positive(hits, classes, F.struct("gap", "target"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 9


def test_best_of_many_metrics(spark):
    d = spark.createDataFrame([(1, 1, 5.0, None), (1, 0, 5.0, 2.0), (2, 0, 1.0, 2.0)], "open int, extend int, mean double, rho double")
    assert sorted(tuple(x) for x in rk.best_of(d, ["mean", "rho"], "open", "extend").collect()) == [("mean", 1, 0, 5.0), ("rho", 1, 0, 2.0)]


def test_near_values_meet_in_cells(spark):
    r = random.Random(6)
    rows = [(i % 3, i, r.choice([r.uniform(-20, 20), 5.0, -5.0, None])) for i in range(120)]
    want = {(p, i, j) for p, i, a in rows for q, j, b in rows if p == q and a is not None and b is not None and abs(i - j) > 5 and abs(a - b) < 2.5}
    got = rl.near_values(spark.createDataFrame(rows, "prot_id int, pos int, at double"), 2.5).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_medoids_and_counts_of_pairs(spark, monkeypatch):
    """Zeros, a lone vector, a null cluster and equal vectors; blocks of a few vectors."""
    from motifgrid.operators import vectors as vo

    r = random.Random(7)
    rows = [(r.choice([1, 2, None]), i, [r.choice([0.0, r.random()]) for _ in range(4)]) for i in range(70)] + [(9, 100, [1.0] * 4), (1, 101, [0.0] * 4), (2, 102, [0.5] * 4), (2, 103, [0.5] * 4)]
    sim = lambda v, w: sum(map(min, v, w)) / (sum(map(max, v, w)) or 1)
    by = defaultdict(list)
    for c, i, v in rows:
        by[c].append((i, v))
    medoids, kinds = {}, {}
    for c, held in by.items():
        medoids[c] = min((round(sum(1 - sim(v, w) for _, w in held), 9), i) for i, v in held)
        over = [round(sim(v, w), 6) >= 0.3 for a, (_, v) in enumerate(held) for _, w in held[a + 1 :]]
        kinds |= {(c, k): n for k, n in (("edge", sum(over)), ("none", len(over) - sum(over))) if n}
    monkeypatch.setattr(vo, "_SPREAD", 2)
    d = spark.createDataFrame(rows, "cluster int, id long, vec array<double>").repartition(3)
    got = {x.cluster: (x.far, x.medoid) for x in vo.cluster_medoid(d).collect()}
    assert set(got) == set(medoids) and all(got[c][1] == medoids[c][1] and abs(got[c][0] - medoids[c][0]) < 1e-6 for c in medoids)
    assert {(x.cluster, x.kind): x.n for x in vo.pairs_over(d, 0.3).collect()} == kinds


def test_nearest_values_meet_no_other_rows(spark):
    """Against sorting all rows for each query: ties in value and in gap, values of queries that no row has, few rows, nulls."""
    rng = np.random.default_rng(8)
    for n, k in ((0, 3), (2, 3), (300, 4)):
        rows = [(i, float(v)) for i, v in enumerate(rng.integers(-20, 20, n))] + [(1000 + i, 5.0) for i in range(9 if n > 2 else 0)]
        queries = [(i, float(v)) for i, v in enumerate((-50, -3, 0, 0, 5, 7.5, 80))]
        q = spark.createDataFrame([*queries, (99, None)], "query long, value double")
        found = od.nearest_values(q, spark.createDataFrame([*rows, (5000, None)], "target long, value double"), k)
        assert "CartesianProduct" not in plan_of(found)
        got = sorted((r.query, r["rank"], r.target, r.gap) for r in found.collect())
        assert got == [(i, at + 1, t, g) for i, v in queries for at, (g, t) in enumerate(sorted((abs(u - v), t) for t, u in rows)[:k])]


def test_sensitivity_and_precision_need_no_pairs_in_shuffles(spark):
    """Against hits made one by one: equal values, copies, classes of one, and queries without a false positive."""
    r = random.Random(5)
    for folds in (3, 1):
        made = [(i, f"a.{r.randrange(folds)}.{r.randrange(2)}.{r.randrange(2)}", float(r.randrange(30))) for i in range(120)]
        p = spark.createDataFrame(made, "prot_id long, fam string, value double").cache()
        q = p.filter("prot_id % 4 = 0")
        hits = q.select(F.col("prot_id").alias("query"), F.col("value").alias("v")).crossJoin(p.select(F.col("prot_id").alias("target"), "value"))
        hits = hits.select("query", "target", F.abs(F.col("value") - F.col("v")).alias("gap"))
        got = rk.first_false_positive_by_gap(p, q)
        assert sorted(got.collect()) == sorted(rk.first_false_positive(hits, p, F.struct("gap", "target")).collect())
        assert "Window" not in plan_of(got)
        x = p.withColumn("fold", F.substring_index("fam", ".", 2))
        two = rk.precision_recall_of(rk.gaps(x, x.filter("prot_id % 4 = 0"), "fam", "fold").withColumn("score", 20 - F.col("gap")), [1.0, 15.0, 18.5])
        one = rk.precision_recall(hits.withColumn("score", 20 - F.col("gap")), p, [1.0, 15.0, 18.5])
        assert np.allclose(sorted(map(tuple, two.collect())), sorted(map(tuple, one.collect())))


def test_pairs_over_a_floor_leave_tasks_as_numbers(spark):
    """A row a cell, however many pairs are similar, and the same numbers."""
    from motifgrid.operators import vectors as vo

    made = [(i, i % 2, [1.0 + (i % 5) / 10, 2.0, 0.0]) for i in range(200)]
    v = spark.createDataFrame(made, "id long, cluster int, vec array<double>")
    rows = vo.similar_pairs(v, 0.3 - 1e-6, "cluster", sure=0.3).collect()
    assert len(rows) < 50 and sum(r.n for r in rows) == 2 * 100 * 99 // 2
    assert sorted(map(tuple, vo.pairs_over(v, 0.3).collect())) == [(0, "edge", 4950), (1, "edge", 4950)]


def test_all_pairs_take_few_bits_in_files(spark, tmp_path):
    """Every query with every reference once, in an order that files hold in far less than the two bytes a pair of plain codes."""
    refs, queries = spark.range(20_020).select((F.col("id") * 7919).alias("target")), spark.range(0, 20_020, 20).select((F.col("id") * 7919).alias("query"))
    rl.all_against_all(queries, refs).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    n = got.agg(F.count("*"), F.count_distinct("query"), F.count_distinct("target"), F.sum((F.col("query") * F.col("target")).cast("decimal(38,0)"))).first()
    total = sum(range(20_020)) * 7919 * sum(range(0, 20_020, 20)) * 7919
    assert tuple(map(int, n)) == (20_020 * 1001, 1001, 20_020, total)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 20_020 * 1001 / 4  # two bits a pair


def test_chunks_are_written_by_one_task_each(spark):
    from motifgrid.plans import catalog

    x = catalog.QUERIES["query_chunks_write_read"](spark, "/root/testdata/sf0.01")
    assert len(x.inputFiles()) == x.select("chunk").distinct().count() > 1
