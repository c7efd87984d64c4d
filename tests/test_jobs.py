"""Jobs from files to files, on the command line and against the operators and plain values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid import jobs
from motifgrid.__main__ import main, parser
from motifgrid.functions import kernels as k
from motifgrid.sources import files


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Eight proteins on helices with letters, count vectors, aligned pairs, names, classes and given LDDT."""
    d, r = tmp_path_factory.mktemp("jobs"), np.random.default_rng(1)
    names = [f"p{i}" for i in range(8)]
    letters = {x: r.integers(0, 4, 12 + i) for i, x in enumerate(names)}
    coords = {x: np.array([(2.3 * math.cos(1.7 * j), 2.3 * math.sin(1.7 * j), 1.5 * j + r.normal(0, 0.2)) for j in range(12 + i)]) for i, x in enumerate(names)}
    np.savez(d / "letters.npz", **letters)
    np.savez(d / "coords.npz", **coords)
    lines = ["c0,prot1,prot2,tm,aln"] + [f'{i},p{i},p{i + 1},0.8,"[{" ".join(str(j) if j % 5 else "-1" for j in range(12 + i))}]"' for i in range(7)] + ['9,d1e25a_,p1,0.9,"[0 1]"', '10,p1,unknown,0.9,"[0 1]"']
    (d / "pairs.csv").write_text("\n".join(lines))
    (d / "given.csv").write_text("\n".join(f"p{i},p{i + 1},{0.5 + i / 20}" for i in range(7)))
    (d / "names.csv").write_text("\n".join(names))
    (d / "queries.csv").write_text("p0\np5\n")
    (d / "classes.tsv").write_text("\n".join(f"{x} a.{i // 4}.{(0, 0, 0, 1)[i % 4]}.{(0, 0, 1, 0)[i % 4]}" for i, x in enumerate(names)))
    vectors = [(x, [[float(c) for c in r.integers(0, 3, 4)] + [5.0] for _ in letters[x]]) for x in names]
    spark.createDataFrame(vectors, "prot_id string, vectors array<array<double>>").write.parquet(str(d / "vectors"))
    return d, letters, coords


def read(spark, path, sep=","):
    return spark.read.option("header", "true").option("sep", sep).option("inferSchema", "true").csv(str(path)).collect()


def test_alphabet_and_search(spark, given):
    d, letters, coords = given
    at = lambda x: str(d / x)
    main(["matrix", "--letters", at("letters.npz"), "--pairs", at("pairs.csv"), "--out", at("m"), "--size", "4"])
    counts = np.zeros((4, 4))
    for i in range(7):
        for j in range(12 + i):
            if j % 5:
                counts[letters[f"p{i}"][j], letters[f"p{i + 1}"][j]] += 1
    s, n = counts.sum(0) + counts.sum(1), counts.sum()
    rows = {(x.a, x.b): x.score for x in read(spark, d / "m")}
    for a in range(4):
        for b in range(4):
            both = counts[a, a] if a == b else counts[a, b] + counts[b, a]
            assert both == 0 or rows[a, b] == round(2 * math.log2(4 * both * n / ((1 if a == b else 2) * s[a] * s[b])))
    main(["alphabet", *sum(([f"--{x}", at(y)] for x, y in (("letters", "letters.npz"), ("coordinates", "coords.npz"), ("train-pairs", "pairs.csv"), ("train-names", "names.csv"), ("pairs", "pairs.csv"), ("given", "given.csv"), ("out", "all"))), []), "--size", "4"])
    assert len(read(spark, d / "all/grid/choices")) == 70 and {x.metric for x in read(spark, d / "all/grid/best")} == {"mean", "median", "rho"}
    assert len(read(spark, d / "all/karlin")) == 1 and spark.read.parquet(at("all/grid/values")).count() == 7 * 70
    search = ["search", "--coordinates", at("coords.npz"), "--queries", at("queries.csv"), "--refs", at("names.csv"), "--letters", at("letters.npz"), "--matrices", at("m"), "--lam", "0.3", "--k", "0.2", "--gap-open", "-4", "--gap-extend", "-1", "--out", at("hits")]
    main([*search, "--query-list", "one"])
    got = files.hits(spark, at("hits")).collect()
    assert len(got) == 16 and {x.query for x in got} == {"p0", "p5"}
    m = np.array([[rows[a, b] for b in range(4)] for a in range(4)], float)
    for x in got:
        sim = m[np.ix_(letters[x.query], letters[x.target])]
        cells = k.aligned_cells(sim, -1.0, -4.0)
        assert abs(x.lddt - k.lddt(coords[x.query], coords[x.target], cells)) < 1e-9
        assert abs(x.score - (0.3 * k.alignment_score(sim, cells, -1.0, -4.0) - math.log(0.2)) / math.log(2)) < 1e-9
    main(["evaluate", "--hits", at("hits"), "--classes", at("classes.tsv"), "--out", at("eval"), "--eligible", "2", "--refs", "8"])
    averages = read(spark, d / "eval/averages")[0]
    assert averages.queries == 2.0 and 0 <= averages.fam <= 1
    assert set(files.evaluation(spark, at("eval/queries")).columns) >= {"NAME", "FAM", "FOLDCNT"}


def test_blurry_search_and_codebook(spark, given):
    d, letters, _ = given
    at = lambda x: str(d / x)
    (d / "blur.csv").write_text("a,b,score\n" + "\n".join(f"{a},{b},{0.6 if a == b else 0.1}" for a in range(5) for b in range(5)))
    (d / "bins.csv").write_text("bin,score\n" + "\n".join(f"{i},{i / 10 - 7}" for i in range(100)))
    main(["search", "--coordinates", at("coords.npz"), "--queries", at("queries.csv"), "--refs", at("names.csv"), "--vectors", at("vectors"), "--matrices", at("blur.csv"), "--jaccard-scores", at("bins.csv"), "--out", at("blurry")])
    assert files.hits(spark, at("blurry")).count() == 16
    with pytest.raises(ValueError):
        jobs.search(spark, at("coords.npz"), at("queries.csv"), at("names.csv"), at("x"), letters=[at("letters.npz")])
    v = spark.read.parquet(at("vectors")).select(F.explode("vectors").alias("v")).select(F.slice("v", 1, 4).alias("x"), F.slice("v", 1, 4).alias("y"))
    v.write.parquet(at("tensor"))
    main(["train", "--pairs", at("tensor"), "--validation", at("tensor"), "--out", at("book"), "--codes", "4", "--epochs", "2"])
    assert len(read(spark, d / "book/history")) == 2
    main(["encode", "--codebook", at("book/codebook"), "--vectors", at("vectors"), "--out", at("coded")])
    assert {x.prot_id: len(x.letters) for x in jobs.letters_of(spark, at("coded")).collect()} == {x: len(v) for x, v in letters.items()}


def test_options():
    got = parser().parse_args(["gap-grid", "--coordinates", "c", "--pairs", "p", "--given", "g", "--out", "o", "--letters", "a", "b", "--matrices", "m", "n", "--weightings", "0.3", "0.7", "--weightings", "0.5", "0.5"])
    assert got.weightings == [[0.3, 0.7], [0.5, 0.5]] and got.letters == ["a", "b"] and len(got.opens) * len(got.extends) == 70


def test_import_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, motifgrid.jobs; print(len(e.queries()))"], capture_output=True, text=True, cwd=jobs.__file__.rsplit("/", 2)[0])
    assert int(done.stdout.split()[-1]) > 100, done.stderr
