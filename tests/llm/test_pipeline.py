"""Each stage keeps the columns and does what its decisions say, on the smallest tables and on odd rows."""

import random
import re
from collections import Counter

import corpus_pipeline as c
import pytest
from pyspark.sql import functions as F
from test_operators import components, minhash_words

from motifgrid.llm import language, quality
from motifgrid.llm.common import written

DATA = "/root/testdata/sf0.001"
SPEC = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, __row string, __kept string, ids string"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["language_id", "quality_rules", "minhash_dedup", "pii", "packing"]
    for name, stage in c.STAGES:
        out = written(stage(spark, docs, DATA), name)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
            break
        assert out.dtypes == docs.dtypes
        if name == "language_id":
            assert out.count() == language.language_of(docs).filter(f"lang_pred <> 'und' and score >= {c.LEAST_SCORE}").count()
        if name == "quality_rules":
            assert out.count() == sum(r.kept for r in quality.measured(docs).collect())
        if name == "minhash_dedup":
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            assert out.select("text").distinct().count() == out.count() < docs.count()
        if name == "pii":
            assert out.count() == docs.count() and out.filter("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]'").count() == 0
            assert out.filter("n_chars <> length(text)").count() == 0
        docs = out


def test_run_and_empty(spark):
    assert c.run(spark, DATA).count() > 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, DATA), f"empty-{name}")
    assert docs.count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows and ids, a very long text, near copies, personal data; columns that clash with those of the stages."""
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(900)]
    prose = lambda n: ". ".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(n)) + "."
    one, other = prose(12), prose(12)
    rows = [(1, one), (1, one), (9, one), (9, other), (2, one + " and more"), (3, None), (4, ""), (None, prose(10)), (5, prose(3000)), (6, f"write to a.b@c.org now. {prose(10)}"), (7, prose(9)), (None, None), (8, "few words")]
    rows = [(d, t, "en" if i % 3 else None, r.choice(["a", None]), len(t or ""), "r", "s", "w", "k", "i") for i, (d, t) in enumerate(rows)]
    return written(spark.createDataFrame(rows, SPEC).repartition(3), "odd"), rows


def test_dedup_of_odd_rows(spark, odd):
    docs, rows = odd
    out = c.dedup_stage(spark, docs, DATA)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    sets = {i: minhash_words((x[1] or "").lower()) or {x[1]} - {None, ""} for i, x in enumerate(rows)}
    groups = Counter(components(sets).values())
    assert len(got) == len(groups)
    kept = Counter(tuple(x) for x in got)
    for first in groups:
        members = [rows[i] for i, g in components(sets).items() if g == first]
        assert sum(kept[m] for m in set(members)) == 1 or members[0][1] in (None, "")


def test_dedup_when_splits_change(spark):
    """A table that is read with other splits than it was when the stage was built gives the same rows."""
    docs = written(spark.read.parquet(f"{DATA}/documents.parquet").repartition(3), "splits")
    want, kept = len({*components({r.doc_id: minhash_words((r.text or "").lower()) or {r.text or r.doc_id} for r in docs.collect()}).values()}), "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(kept, "1")
        out = c.dedup_stage(spark, docs, DATA)
        spark.conf.set(kept, "3")
        assert out.count() == out.select("doc_id").distinct().count() == want
    finally:
        spark.conf.unset(kept)


def test_other_stages_on_odd_rows(spark, odd):
    docs, rows = odd
    want = Counter((x[0], x[1]) for x in rows)
    for name in ("language_id", "quality_rules"):
        out = dict(c.STAGES)[name](spark, docs, DATA)
        got = Counter((x.doc_id, x.text) for x in out.collect())
        assert out.dtypes == docs.dtypes and not got - want and (5, rows[8][1]) in got and not {(3, None), (4, ""), (None, None)} & set(got), name
    hidden = dict(c.STAGES)["pii"](spark, docs, DATA)
    plain = Counter((d, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t) if t else t) for d, t in want.elements())
    assert hidden.dtypes == docs.dtypes and Counter((x.doc_id, x.text) for x in hidden.collect()) == plain
    pieces = dict(c.STAGES)["packing"](spark, docs, DATA)
    starts = pieces.filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert Counter({x.doc_id: x.n for x in starts}) == Counter(x[0] for x in rows)
