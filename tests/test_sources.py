"""Readers and writers on small files, and expressions on hand values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.functions import geometry as g
from motifgrid.functions import sequences as sq
from motifgrid.functions import vectors as ve
from motifgrid.operators import relations as rl
from motifgrid.sources import files
from motifgrid.streaming import hits as stream


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def atom(n, name, res, seq, x, y, z):
    return f"ATOM  {n:5d}  {name:<3} {res} A{seq:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C"


@pytest.fixture()
def structure(tmp_path):
    lines, n = [], 0
    for i in range(12):
        res = "GLY" if i == 3 else "ALA"
        a = math.radians(100 * i)
        for k, (name, r, up) in enumerate((("N", 1.5, 0.0), ("CA", 2.3, 0.9), ("C", 1.7, 1.9), ("CB", 3.3, 0.7))):
            if not (name == "CB" and res == "GLY"):
                n += 1
                lines.append(atom(n, name, res, i + 1, r * math.cos(a + k / 3), r * math.sin(a + k / 3), 1.5 * i + up))
    (tmp_path / "p1_").write_text("\n".join(["HEADER", *lines, "END"]))
    return str(tmp_path / "p1_")


def test_structure(spark, structure):
    assert files.atoms(spark, structure).count() == 47
    r = files.residues(spark, structure)
    rows = {x.pos: x for x in r.collect()}
    assert len(rows) == 12 and rows[3].cb is not None and rows[0].phi is None and rows[0].ss == "X" and rows[5].phi is not None
    assert files.residue_sequence(r).first().sequence == "AAAGAAAAAAAA"
    assert files.backbone_angles(r).count() == 10
    n = files.neighbourhoods(r)
    ca = {p: np.array([x.ca.x, x.ca.y, x.ca.z]) for p, x in rows.items()}
    want = {(i, j) for i in ca for j in ca if abs(i - j) > 5 and np.linalg.norm(ca[i] - ca[j]) < 14.85}
    assert {(x.pos, x.nbr_pos) for x in n.collect()} == want and n.filter("bin_id not between 0 and 999").count() == 0


def test_angles_stop_at_a_break(spark, structure, tmp_path):
    """Residues on both sides of a gap in the chain lack the angle across it."""
    lines = [x if not x.startswith("ATOM") or int(x[22:26]) < 7 else f"{x[:46]}{float(x[46:54]) + 4:8.3f}{x[54:]}" for x in open(structure).read().split("\n")]
    (tmp_path / "p2_").write_text("\n".join(lines))
    whole, cut = ({x.pos: x for x in files.residues(spark, p).collect()} for p in (structure, str(tmp_path / "p2_")))
    assert whole[5].psi is not None and whole[6].phi is not None
    assert cut[5].psi is None and cut[6].phi is None and cut[5].ss == cut[6].ss == "X"
    assert cut[5].phi == whole[5].phi and abs(cut[6].psi - whole[6].psi) < 1e-9 and cut[4].ss == whole[4].ss


def test_resample_is_poisson_and_keyed(spark):
    d = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    got = [(r.id, r.v) for r in rl.resampled(d.repartition(3), "id", 1.5, seed=4).collect()]
    assert sorted(got) == sorted((r.id, r.v) for r in rl.resampled(d.repartition(5), "id", 1.5, seed=4).collect())
    n = np.bincount([i for i, _ in got], minlength=20_000)
    for k in range(5):
        assert abs((n == k).mean() - math.exp(-1.5) * 1.5**k / math.factorial(k)) < 0.015
    assert rl.resampled(d, "id", 0.0).count() == 0 and len(got) != rl.resampled(d, "id", 1.5, seed=5).count()


def test_functions_in_sql(spark):
    from motifgrid.functions import surface

    surface.register(spark)
    one = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert one("SELECT jaccard(array(1D, 2D, 0D), array(0.5D, 3D, 0D)), jaccard(array(0D), array(0D)), jaccard(null, array(1D)), jaccard(array(1D), array(1D, 2D))") == [(0.625, None, None, None)]
    assert one("SELECT c.* FROM LATERAL parse_cigar('2M1D1M', 1, 1) c") == [(0, "M", 2, 0, 0), (1, "D", 1, 2, 2), (2, "M", 1, 2, 3)]
    assert one("SELECT count(*) FROM LATERAL parse_cigar(null, 1, 1) c") == [(0,)]
    assert one("SELECT c.* FROM LATERAL expand_alignment(array(-1, 0, 1, 4)) c") == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, None, 2), (4, None, 3), (5, 3, 4)]


def test_alignments_names_and_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('c0,prot1,prot2,tm,aln\n0,a,b,0.5,"[0 1 -1]"\n1,a,b,0.6,"[ 2  -1 ]"\n2,c,d,0.7,"[x 1]"\n')
    rows = files.alignments(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.prot1, r.tm, r.aln) for r in rows] == [("a", 0.6, [2, -1])]
    (tmp_path / "n.csv").write_text("a,b\nc\n")
    assert sorted(r.prot_id for r in files.names(spark, str(tmp_path / "n.csv")).collect()) == ["a", "b", "c"]
    files.write_names(spark.createDataFrame([("a",)], "prot_id string"), str(tmp_path / "out"))
    assert files.names(spark, str(tmp_path / "out")).count() == 1
    names = spark.createDataFrame([(f"n{i:02d}",) for i in range(25)], "prot_id string")
    files.write_chunks(rl.chunks(names, "prot_id"), str(tmp_path / "chunks"))
    assert spark.read.csv(str(tmp_path / "chunks")).groupBy("chunk").count().count() == 3


def test_settings_reports_and_arrays(spark, tmp_path):
    (tmp_path / "s.txt").write_text("gap_open: -10\nblurry: True\nuse_two: False\nbad line\na:b:c\n")
    assert files.settings(spark, str(tmp_path / "s.txt"), {"gap_open": float, "blurry": bool, "use_two": bool}) == {"gap_open": -10.0, "blurry": True}
    files.write_settings(spark.createDataFrame([("r1", {"b": "2", "a": "1"})], "run string, options map<string,string>"), str(tmp_path / "w"))
    assert files.settings(spark, str(tmp_path / "w")) == {"a": "1", "b": "2"}
    np.savez(tmp_path / "x.npz", p=np.arange(6.0).reshape(2, 3))
    r = files.arrays(spark, str(tmp_path / "x.npz")).first()
    assert (r.prot_id, r.rows, r.cols, r.data[5]) == ("p", 2, 3, 5.0)
    (tmp_path / "c.tsv").write_text("p1 a.1.2.3\np2\n")
    assert files.classes(spark, str(tmp_path / "c.tsv")).collect()[0].fam == "a.1.2.3"
    (tmp_path / "DIM20_s1_params.pkl").write_text("0.9\n0.8\n")
    assert files.values_by_size(spark, str(tmp_path / "DIM*")).first().asDict() == {"n": 20, "values": [0.8, 0.9]}


def test_fasta_numbers_follow_files_and_places(spark, tmp_path):
    for name, n in (("b.fa", 40), ("a.fa", 30)):
        (tmp_path / name).write_text("".join(f">{name}{i:02d}\n{'ACGT' * 20}\n" for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("600b", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = {r.contig: r.header for r in files.fasta(spark, str(tmp_path)).collect()}
            assert got == {i: x for i, x in enumerate([f"a.fa{i:02d}" for i in range(30)] + [f"b.fa{i:02d}" for i in range(40)])}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_cigar_and_tensor_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tb\t1\t3\t2M1D\nc\td\tx\t1\t5M\n")
    assert [tuple(r) for r in files.cigars(spark, str(tmp_path / "c.tsv")).orderBy("prot1").collect()] == [("a", "b", 1, 3, "2M1D"), ("c", "d", None, 1, "5M")]
    d = spark.createDataFrame([([float(i)], [float(-i)]) for i in range(30)], "x array<float>, y array<float>")
    d.write.parquet(str(tmp_path / "t"))
    got = [(r.x[0], r.y[0]) for r in files.tensor_pairs(spark, str(tmp_path / "t")).collect()]
    assert sorted(got) == [(float(i), float(-i)) for i in range(30)] and got != sorted(got)


def test_fasta(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">one x\nACGT 10\nNNAC\n>two\nTT\n")
    d = files.fasta(spark, str(tmp_path / "f.fa"))
    assert [(r.header, r.sequence) for r in d.orderBy("contig").collect()] == [("one x", "ACGTNNAC"), ("two", "TT")]
    masks = spark.createDataFrame([(0, 2, 3)], "contig long, a int, b int")
    r = files.fasta_range(d, 2, 5, True, masks).orderBy("contig").collect()
    assert r[0].sequence == "NAXX" and r[1].sequence == "A"


def test_expressions(spark):
    cols = value(spark, sq.cigar_columns(sq.parsed_cigar(F.lit("2M1D1M")), F.lit(1), F.lit(1)))
    assert [(c.i, c.j) for c in cols] == [(0, 0), (1, 1), (None, 2), (2, 3)]
    cols = value(spark, sq.gapped_columns(F.array(*[F.lit(x) for x in (-1, 0, 1, 4)])))
    assert [(c.i, c.j) for c in cols] == [(0, None), (1, 0), (2, 1), (None, 2), (None, 3), (3, 4)]
    assert value(spark, g.torus_distance(F.lit(3.0), F.lit(0.0), F.lit(-3.0), F.lit(0.0))) == pytest.approx(2 * math.pi - 6)
    assert value(spark, g.interval(F.lit(0.0), g.edges()["r"])) == 0
    assert value(spark, ve.weighted_jaccard(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(3.0), F.lit(0.0)))) == 0.625
    assert value(spark, ve.similarity_score(F.lit(0.0), F.array(F.lit(-4), F.lit(5)))) == 0
    assert value(spark, sq.residue_letter(F.lit("gly"))) == "G" and value(spark, sq.residue_letter(F.lit("MSE"))) == "X"
    assert value(spark, sq.masked(F.lit("abcd"), F.lit(2), F.lit(9))) == "aXXX"
    assert value(spark, sq.dna_score(F.lit("A"), F.lit("G"))) == -10 and value(spark, sq.dna_score(F.lit("A"), F.lit("N"))) is None


def test_guard_and_cells(spark):
    pairs = spark.createDataFrame([("a", "b")], "prot1 string, prot2 string")
    assert rl.guarded(pairs, spark.createDataFrame([("z",)], "n string")).count() == 1
    with pytest.raises(Exception, match="excluded"):
        rl.guarded(pairs, spark.createDataFrame([("b",)], "n string")).collect()


def test_hit_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = [("a1", "a.1.1"), ("a2", "a.1.1"), ("a3", "a.1.2"), ("b1", "a.2.1")]
    classes = spark.createDataFrame([(n, f"x.{f}") for n, f in names], "prot_id string, fam string")
    rows = ["a1 a1 1 1 1 1", "a1 a2 1 1 1 2", "a1 a3 1 1 1 3", "a1 zz 1 1 1 4", "a1 b1 1 1 1 5"]
    (tmp_path / "in/h.csv").write_text("\n".join(rows))
    got = []
    q = stream.evaluate_stream(stream.hit_stream(spark, str(tmp_path / "in")), classes, lambda d, n: got.extend(d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.query, r.fam, r.fp) for r in got] == [("a1", 1.0, 1)]
