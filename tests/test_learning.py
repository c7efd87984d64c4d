import numpy as np
from pyspark.sql import functions as F

from motifgrid.operators import learning as le


def pairs_of(spark, n=600):
    """Pairs in id order; those of the first half point along the first axis, the others along the second."""
    rows = [([1.0 + i % 7, 0.1], [1.0 + i % 5, 0.2]) if i < n // 2 else ([0.1, 1.0 + i % 7], [0.2, 1.0 + i % 5]) for i in range(n)]
    return spark.createDataFrame(rows, "x array<double>, y array<double>"), rows


def test_codebook_trains_in_tasks(spark):
    """Every pair is in one task's share; averaged tasks learn, and validation follows."""
    d, rows = pairs_of(spark)
    table = le.dealt(d, 100, len(rows))
    shares = table.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(shares) > 1 and sorted((tuple(r.x), tuple(r.y)) for r in table.collect()) == sorted((tuple(x), tuple(y)) for x, y in rows)
    for chunk in (100, 10_000):
        book, history = le.trained_codebook(d, codes=4, hidden=8, epochs=6, chunk=chunk, batch=32, rate=1e-2, validation=d)
        assert len(history) == 6 and history[-1]["validation_loss"] < 0.7 * history[0]["validation_loss"] and history[-1]["perplexity"] > 1.2
        x = np.array([r[0] for r in rows])
        got = {r.id: r.code for r in le.encoded(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "id long, vec array<double>"), book).collect()}
        assert got == dict(enumerate(book.nearest(book.latent(x[:50])).tolist()))


def test_codebook_layers():
    """Folded layers give what normalisation with the seen means gives; packing is a round trip; the decoder's gradient is exact."""
    r = np.random.default_rng(1)
    book = le.Codebook(5, 6, 2, 3)
    x, y = r.random((40, 5)), r.random((40, 5))
    for _ in range(5):
        book.step(x, y)
    w = book.weights
    a = (x @ w["w1"] + w["b1"] - book.seen["m1"]) / np.sqrt(book.seen["v1"] + 1e-5) * w["g1"] + w["o1"]
    assert np.allclose(book.latent(x), np.maximum(a, 0) @ w["w2"] + w["b2"])
    same = book.unpacked(book.packed(), book.steps)
    assert all((same.weights[k] == w[k]).all() for k in w) and same.steps == 5

    def loss(k, i, by):
        other = book.unpacked(book.packed(), 0)
        other.weights[k].flat[i] += by
        return other.step(x, y, rate=0.0)

    fresh = book.unpacked(book.packed(), 0)
    for k in fresh.weights:
        fresh.first[k][:], fresh.second[k][:] = 0, 0
    fresh.step(x, y, rate=0.0)
    for k in ("w3", "b3", "g3", "o3", "w4", "b4"):
        for i in range(0, w[k].size, 3):
            assert abs(fresh.first[k].flat[i] / 0.1 - (loss(k, i, 1e-6) - loss(k, i, -1e-6)) / 2e-6) < 1e-6


def test_gradient_of_centres(spark):
    """The slope equals finite differences, and its sum over tasks equals one task's."""
    r = np.random.default_rng(2)
    left, right, c = r.random((30, 6)), r.random((30, 6)), r.random((4, 6))
    loss = lambda m: le.information_loss(le.soft_counts(m, left, right, 7.0))
    got = le.centre_slope(c, left, right, 7.0, le.loss_slope(le.soft_counts(c, left, right, 7.0)))
    for i in range(c.size):
        up, down = c.copy(), c.copy()
        up.flat[i] += 1e-6
        down.flat[i] -= 1e-6
        assert abs(got.flat[i] - (loss(up) - loss(down)) / 2e-6) < 1e-6
    d = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(left, right, strict=True)], "x array<double>, y array<double>").repartition(3)
    assert np.allclose(le.whole_slope(d, c, 7.0), got)


def test_centres_draw_from_the_whole_table(spark):
    d, rows = pairs_of(spark)
    x, _ = le.drawn(d, 100, 0)
    assert 40 < len(x) < 200 and 0.2 < (x[:, 1] > x[:, 0]).mean() < 0.8
    left, right = (np.array([r[k] for r in rows]) for k in (0, 1))
    whole = lambda c: le.information_loss(le.soft_counts(c, left, right, 100.0))
    c = le.learned_centres(d, 4, batch=50, steps=12, every=5, rate=0.05)
    assert abs(le.whole_loss(d, c, 100.0) - whole(c)) < 1e-9
    start = le.learned_centres(d, 4, batch=50, steps=0, every=5)
    assert whole(c) <= whole(start) and whole(le.learned_centres(d, 4, batch=None, steps=3, every=3, rate=0.05)) <= whole(start) + 1


def test_communities_by_joins(spark):
    """Two cliques joined by one weak edge: every node of a clique has one cluster, on the driver or by joins; a node without edges is alone."""
    edges = [(a, b, 0.9) for h in (0, 20) for a in range(h, h + 20) for b in range(a + 1, h + 20)] + [(0, 20, 0.1)]
    graph = spark.createDataFrame(edges, "a long, b long, sim double")
    nodes = spark.createDataFrame([(i,) for i in [*range(40), 99]], "id long")
    for most in (100, 24):
        got = {r.id: r.cluster for r in le.graph_communities(graph, nodes, [1.0], most).collect()}
        assert set(got) == {*range(40), 99} and got[99] == 99
        assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[20]
    assert le.graph_communities(graph.filter("false"), nodes.filter("false"), [1.0], 24).count() == 0


def test_modularity_by_joins_is_as_good(spark):
    r = np.random.default_rng(8)
    edges = [(a, b, float(r.random())) for a in range(300) for b in range(a + 1, 300) if r.random() < (0.4 if a // 30 == b // 30 else 0.02)]
    graph = spark.createDataFrame(edges, "a long, b long, sim double").repartition(3)
    nodes = spark.range(300).select("id")
    one = le.graph_communities(graph, nodes, [1.0]).select("id", "cluster")
    by_joins = le.graph_communities(graph, nodes, [1.0], most=2).select("id", "cluster")
    a, b = le.modularity(graph, one), le.modularity(graph, by_joins)
    assert by_joins.count() == 300 and a > 0.4 and b > 0.98 * a


def test_similar_pairs_by_brute_force(spark):
    """With and without the index, on dense and sparse vectors, equal ones, and one component that most have."""
    from motifgrid.operators import vectors as vo

    r = np.random.default_rng(5)
    dense = r.gamma(1.0, size=(90, 6))
    sparse = np.where(r.random((160, 40)) < 0.12, r.integers(1, 4, (160, 40)), 0).astype(float)
    sparse[:, 3] = np.where(r.random(160) < 0.8, 1.0, 0.0)
    sparse[100:120] = sparse[99]
    sparse[100:120, 7] += r.integers(0, 2, 20)
    for vecs, least in ((dense, 0.6), (sparse, 0.45)):
        n = vecs.shape[1]
        made = [(int(i), int(i % 2), [float(x) for x in v]) for i, v in enumerate(vecs)] + [(200, 0, [0.0] * n), (201, 1, [1.0] * n), (202, 1, [1.0] * n)]
        d = spark.createDataFrame(made, "id long, g int, vec array<double>")
        for group in (None, "g"):
            want = {
                (a, b): np.minimum(v, w).sum() / np.maximum(v, w).sum()
                for a, g, v in made for b, h, w in made if a < b and (group is None or g == h) and sum(v) and sum(w) and np.minimum(v, w).sum() / np.maximum(v, w).sum() >= least
            }
            assert len(want) > 100 or vecs is dense
            for index in (True, False, None):
                rows = vo.similar_pairs(d, least, group, index).collect()
                got = {(x.a, x.b): x.sim for x in rows}
                assert len(rows) == len(got) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
                assert group is None or all(x.g == made[x.a][1] for x in rows if x.a < 200)


def test_sparse_vectors_meet_in_few_lists(spark):
    """The index is taken for sparse vectors, and its lists hold far fewer pairs than all vectors make."""
    from motifgrid.operators import vectors as vo

    r = np.random.default_rng(6)
    vecs = np.zeros((600, 300))
    for v in vecs:
        v[r.choice(300, 12, replace=False)] = r.integers(1, 5, 12)
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    t = vo.total(F.col("vec"))
    n = [x.n for x in vo._postings(d.withColumn("t", t), 0.5, []).groupBy("dim").agg(F.count("*").alias("n")).collect()]
    assert sum(x * x for x in n) < 0.25 * 600**2
    assert vo.similar_pairs(d, 0.5).count() == vo.similar_pairs(d, 0.5, index=False).count()


def test_pairs_are_bounded_before_they_are_taken(monkeypatch):
    """Few dense pairs are taken exactly, and none is missed: beside brute force, for totals far apart, equal vectors, and components that are all or nothing."""
    from motifgrid.operators import vectors as vo

    r = np.random.default_rng(8)
    gauss = np.maximum(r.normal(0, 0.125, (900, 64)), 0)
    wide = np.abs(r.normal(0, 1, (300, 5))) * 10.0 ** r.integers(-30, 30, (300, 1))
    for v, least in ((gauss, 0.3), (wide, 0.5), (np.repeat(gauss[:20], 30, axis=0), 0.9), ((r.random((200, 8)) < 0.4) * 1.0, 0.6), (gauss * 1e-200, 0.3), (gauss * 1e150, 0.3)):
        v = v[v.sum(axis=1) > 0]
        v = v[np.argsort(v.sum(axis=1), kind="stable")]
        t, exact = v.sum(axis=1), []
        for own in (True, False):
            a, b = (v, v) if own else (v[::2], v[1::2])
            sim = np.array([np.minimum(x, b).sum(axis=1) / np.maximum(x, b).sum(axis=1) for x in a])
            want = {(i, j) for i, j in np.argwhere(sim >= least).tolist() if not own or i < j}
            found = [x for x in vo._near(a, None if own else b, t if own else t[::2], t if own else t[1::2], least, -1)]
            got = [(i, j) for x, y, _ in found for i, j in zip(x.tolist(), y.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
            assert all(np.array_equal(s, sim[x, y]) for x, y, s in found)
    taken, least_of = [], np.minimum
    monkeypatch.setattr(vo.np, "minimum", lambda x, y: taken.append(len(x)) or least_of(x, y))
    v = gauss[np.argsort(gauss.sum(axis=1))]
    for _ in vo._near(v, None, v.sum(axis=1), v.sum(axis=1), 0.35, -1):
        pass
    assert 0 < sum(taken) < 0.02 * 900 * 899 / 2


def test_nearest_neighbours_leave_tasks_k_a_node(spark, monkeypatch):
    """As by all pairs: ties after rounding, copies, and few rows for each node from a task however many are similar."""
    from motifgrid.operators import vectors as vo

    r = np.random.default_rng(9)
    vecs = np.concatenate([r.gamma(1.0, size=(120, 5)), np.repeat(r.gamma(1.0, size=(3, 5)), 40, axis=0)])
    d = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(vo, "_BLOCK_VALUES", 200)
    for digits in (6, 1):
        pairs = vo.similar_pairs(d, 0.3).select("a", "b", (F.round("sim", digits) + 0.0).alias("sim"))
        want = sorted(map(tuple, vo.neighbour_graph(pairs, 7).collect()))
        assert sorted(map(tuple, vo.nearest_neighbours(d, 0.3, 7, digits).collect())) == want
    few = vo.similar_pairs(d, 0.3, best=(2, 6)).count()
    assert 240 * 2 <= few <= 240 * 2 * 6 < pairs.count() / 3  # six blocks


def test_centres_are_compared_in_few_steps_and_passes(spark, monkeypatch):
    """A step takes the similarities of a batch centre by centre, and the losses of all kept centres are one pass over the pairs."""
    from motifgrid.functions import kernels

    r = np.random.default_rng(11)
    a, b = r.gamma(1.0, size=(500, 6)), r.gamma(1.0, size=(3, 6))
    want = np.array([[np.minimum(x, y).sum() / np.maximum(x, y).sum() for y in b] for x in a])
    steps, most = [], np.maximum
    monkeypatch.setattr(kernels.np, "maximum", lambda *x: steps.append(1) or most(*x))
    assert np.array_equal(kernels.jaccard_similarity(a, b), want) and len(steps) == 3
    monkeypatch.undo()
    d = spark.createDataFrame([([float(k) for k in x], [float(k) for k in y]) for x, y in zip(a[:200], a[200:400], strict=True)], "x array<double>, y array<double>")
    assert np.allclose(le.whole_losses(d, [b, 2 * b], 20.0), [le.whole_loss(d, c, 20.0) for c in (b, 2 * b)])
    passes, summed = [], le._summed
    monkeypatch.setattr(le, "_summed", lambda *x: passes.append(1) or summed(*x))
    one = le.learned_centres(d, 3, batch=50, steps=10, every=5)
    assert len(passes) == 1 and np.array_equal(one, le.learned_centres(d.repartition(5), 3, batch=50, steps=10, every=5))


def test_nodes_of_a_part_move_one_after_another():
    """A part finds both of two joined cliques in one round; a node of another part is seen, and stays."""
    import pandas as pd

    pairs = [(a, b) for a in range(8) for b in range(8) if a != b and (a // 4 == b // 4 or {a, b} == {3, 4})]
    own = [p for p in pairs if p[0] < 7]
    k = np.bincount([a for a, _ in pairs]).astype(float)
    nodes = pd.DataFrame({"x": range(7), "k": k[:7], "c": range(7), "held": k[:7], "size": 1, "turn": True})
    y = np.array([b for _, b in own])
    ends = pd.DataFrame({"x": [a for a, _ in own], "y": y, "w": 1.0, "yc": y, "yheld": k[y], "ysize": 1})
    found = le._moved_inside(nodes, ends, 1.0, float(k.sum()), 10, 0)
    assert len(set(found[:4])) == 1 and len(set(found[4:])) == 1 and found[0] != found[4]
