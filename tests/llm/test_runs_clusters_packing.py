"""Periodic runs, centroid clustering and best-fit packing against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from motifgrid.llm import centroids, exact_packing, periodic, tokens

WORDS = P.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, part string, runs string, length int, tie string"


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): prose, repeated passages, nulls, empty and very long texts, repeated rows."""
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ".", "!!", "\n"]) for _ in range(n))
    out = [(i, prose(r.randint(1, 120))) for i in range(80)]
    out += [(100 + i, f"{prose(5)} " + f"{prose(r.randint(1, 6))} " * r.randint(3, 9) + prose(5)) for i in range(40)]
    out += [(300, None), (301, ""), (302, " \n\t "), (None, "no id no id no id no id here"), (5, "twice"), (5, "twice"), (303, "x" * 20_000), (304, prose(30_000)), (305, "a b " * 9_000), (306, "Don't  <|endoftext|> 🙂 ½\x85x y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "en", "s", 1, "i", "p", "r", 3, "t") for x in rows], DOC).repartition(3)


def plain_runs(w):
    """Every maximal stretch of every period, if no smaller one is its own."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(6, 4 * p) and not any(all(w[j] == w[j + q] for j in range(s, s + length - q)) for q in range(1, p)):
                out.append((s, length, p))
            i += i == s
    return sorted(out)


def test_runs_equal_all_periods(monkeypatch):
    r = random.Random(1)
    for t in range(6000):
        if t == 3000:
            monkeypatch.setattr(periodic, "GRID_WORDS", 8)
            periodic._grid.cache_clear()
        n = r.randrange(70)
        w = [r.randrange(r.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        for _ in range(r.randrange(3) if n > 5 else 0):
            a, p = r.randrange(n), r.randrange(1, 9)
            for i in range(a, min(n, a + r.randrange(60))):
                w[i] = w[a + (i - a) % p]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w), w
    periodic._grid.cache_clear()
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.runs(np.arange(100_000) % 7_000) == [(0, 100_000, 7_000)]


def test_run_digests(docs, rows):
    def brute(doc, text):
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        n, g, first = len(w), h // 10, list(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [first[a + (i - a) % p] if i >= a else first[i] for i in range(n)]
        found = plain_runs(w) if n < 2_000 else periodic.runs(np.unique(np.array(w), return_inverse=True)[1])
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in found).encode()
        return doc, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest(lines), digest(b" ".join(x for i, x in enumerate(w) if i not in gone))

    got = periodic.run_digests(periodic.periodic_runs(docs, rewritten=periodic.with_repeats)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*x)) for x in rows)
    assert sum(r.n_runs for r in got) > 20
    kept = {r.doc_id: r.collapsed for r in periodic.periodic_runs(docs).collect()}
    assert kept[305] == "a b" and kept[300] == kept[301] == "" and kept[None] == "no id here"
    assert periodic.run_digests(periodic.periodic_runs(docs.filter("false"))).count() == 0


def lloyd(vectors, k, rounds):
    """(cluster, distance) of each vector and the centroids, in whole numbers; vectors: (id, components)."""
    key = lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1])
    centres = [list(v) for _, v in sorted(vectors, key=key)[:k]]
    for i in range(rounds + 1):
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for _, v in vectors]
        own = [min(range(len(centres)), key=lambda c: (d[c], c)) for d in apart]  # noqa: B023
        for c in range(len(centres)) if i < rounds else ():
            if mine := [v for (_, v), o in zip(vectors, own, strict=True) if o == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return own, [d[c] for d, c in zip(apart, own, strict=True)], centres


@pytest.mark.parametrize("spread", [1, 30, 3e8, 1e14])
def test_clusters_equal_plain_rounds(spark, spread):
    r = random.Random(int(spread))
    vectors = [(i, [round(r.gauss(0, spread), 2 if spread > 1 else 0) for _ in range(3)]) for i in range(150)]
    vectors += [(i, [0.5, 0.25, 0.0]) for i in range(200, 230)] + [(5, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [1.0, float("-inf"), 2.0])]
    table = spark.createDataFrame([(*x, "c", 1.0) for x in vectors + odd], "vec_id long, embedding array<double>, cluster string, distance double").repartition(3)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    own, apart, centres = lloyd(whole, 7, 4)
    found = centroids.clustered(centroids.quantised(table, 3), k=7, rounds=4, dims=3)
    want = sorted(zip([str(i) for i, _ in whole], own, [min(d, 2**63 - 1) for d in apart], strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.rows.collect()) == want
    assert found.centroids == centres
    shown = centroids.with_digests(found).collect()
    assert len(shown) == len(whole)
    for x in shown:
        assert x.cluster_inertia == min(2**63 - 1, sum(d for _, c, d in want if c == x.cluster)) and x.inertia == min(2**63 - 1, sum(d for _, _, d in want))
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[x.cluster])).encode()).hexdigest()


def test_few_vectors_or_none(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = centroids.quantised(table, 2)
    assert sorted(tuple(r) for r in centroids.with_digests(centroids.clustered(rows, 5, 2, 2)).select("vec_id", "distance", "inertia").collect()) == [(1, 0, 0), (2, 0, 0)]
    assert centroids.with_digests(centroids.clustered(rows.filter("false"), 5, 2, 2)).count() == 0


def test_bounds_save_distances():
    r = np.random.default_rng(3)
    values = (r.normal(0, 300, (40, 8))[r.integers(0, 40, 4000)] + r.normal(0, 20, (4000, 8))).round()
    centres = values[:40].copy()
    state, made = centroids.State.scanned(values, centres), 0
    for _ in range(6):
        own = state.near[:, 0]
        new = np.array([np.floor(values[own == c].mean(axis=0)) if (own == c).any() else centres[c] for c in range(40)])
        state.moved(np.sqrt(((new - centres) ** 2).sum(axis=1)) * (1 + centroids.SLACK))
        centres = new
        made += state.settle(values, centres)[0]
        apart = ((values[:, None] - centres) ** 2).sum(axis=2)
        assert (apart.argmin(axis=1) == state.near[:, 0]).all()
        assert (np.sqrt(apart[np.arange(4000), state.near[:, 0]]) <= state.low[:, 0]).all()
        assert (np.take_along_axis(np.sqrt(apart), state.near[:, 1:].astype(int), 1) >= state.low[:, 1:-1]).all()
    assert made < 0.3 * 6 * 4000 * 40


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(WORDS)
    held.encode_special_tokens = True
    r = random.Random(1)
    parts = [*"ab 'sé\n\t.,12 日\x85́ ΣσςAİ\x1c<|>", "<|endoftext|>", " ", "’s", "'S", "'ll", "Hello", "oña", "..."]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(4000)]
    encoder = tokens.WordEncoder(tokens.word_encoder(WORDS).backend, tokens.word_encoder(WORDS).letters, kept=50)
    assert encoder.letters
    for at in range(0, len(made), 500):
        some = made[at : at + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([x.encode() for x in some])] == [e.ids for e in held.encode_batch(some, add_special_tokens=False)]
    assert len(encoder.words) <= 50


def laid_out(plan, counts):
    bins = defaultdict(list)
    for length in np.flatnonzero(counts).tolist():
        for s, o in zip(*map(np.ndarray.tolist, plan.places(np.full(counts[length], length), np.arange(counts[length]))), strict=True):
            bins[s].append((o, length))
    return bins


def least(lengths, window):
    """The least number of sequences, by trying."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in {*gaps}:
            if g >= lengths[i]:
                j = gaps.index(g)
                go(i + 1, [*gaps[:j], g - lengths[i], *gaps[j + 1 :]])
        go(i + 1, [*gaps, window - lengths[i]])

    go(0, [])
    return best


def test_plans_are_whole_and_tight():
    r, over = random.Random(2), 0
    for t in range(1500):
        window = r.randrange(1, 40)
        lengths = [r.randint(1, window) for _ in range(r.randrange(9 if t % 3 else 200))]
        counts = np.bincount(lengths, minlength=window + 1)
        plan = exact_packing.planned(counts, window)
        bins = laid_out(plan, counts)
        assert sorted(bins) == list(range(plan.sequences))
        for x in bins.values():
            ends = [o + length for o, length in sorted(x)]
            assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= window
        if t % 3:
            over += plan.sequences - least(lengths, window)
    assert over <= 20  # of 1000 small cases
    counts = np.zeros(4097, np.int64)
    counts[1:] = 10**12 // np.arange(1, 4097)
    assert exact_packing.planned(counts).sequences == -(-int((counts * np.arange(4097)).sum()) // 4096)


def test_sums_follow_lengths_that_run_out():
    r = np.random.default_rng(1)
    held = r.random(60) < 0.5
    held[0] = False
    sums = exact_packing.Sums(held)
    for x in r.permutation(np.flatnonzero(held)):
        sums.without(int(x))
        held[x] = False
        fresh = exact_packing.Sums(held)
        assert (sums.one == fresh.one).all() and (sums.two == fresh.two).all() and (sums.three == fresh.three).all()


def test_packed_pieces(docs, rows):
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(WORDS)
    held.encode_special_tokens = True
    want, total = [], 0
    for doc, text in rows:
        ids = [*held.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want += [(str(doc), k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    got = exact_packing.packed(docs, WORDS, window=512, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        ends = [o + length for o, length in sorted(x)]
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(bins) <= -(-total // 512) + 2
    assert exact_packing.packed(docs.filter("false"), WORDS).count() == 0
