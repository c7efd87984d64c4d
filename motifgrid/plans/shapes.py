"""Queries on angles, points, vectors, sequences and alignments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..functions import kernels
from ..functions import sequences as sq
from ..functions import surface
from ..functions import vectors as ve
from ..operators import alignment as al
from ..operators import counts as ct
from ..operators import learning as le
from ..operators import ranking as rk
from ..operators import relations as rl
from ..operators import vectors as vo
from .base import B, L, LETTERS, ORACLE, P, PT, V, aligned, jac, letters, points, query, r6, read, vectors

_SS = "CASE WHEN psi BETWEEN -1.47 AND 0.63 AND phi BETWEEN -2.51 AND -0.42 THEN 'R' WHEN psi BETWEEN -0.84 AND 1.26 AND phi BETWEEN 0.63 AND 2.51 THEN 'L' WHEN (psi BETWEEN 0.63 AND 3.14 AND phi BETWEEN -pi() AND -0.42) OR (psi BETWEEN -pi() AND -2.09 AND phi BETWEEN -pi() AND -0.84) THEN 'B' ELSE 'X' END"


@query(f"WITH {PT} SELECT {_SS} AS ss, resname, count(*) AS n FROM T GROUP BY ALL")
def ss_class(spark, d):
    return points(spark, d).groupBy(ge.structure_class(F.col("phi"), F.col("psi")).alias("ss"), "resname").agg(F.count("*").alias("n"))


def _r(x):
    return f"round({x}, 6) + 0.0"


@query("SELECT 'r' AS axis, CAST(range AS INTEGER) AS i, round(power(3375.0 * range / 5, 1.0 / 3), 6) AS edge FROM range(6) UNION ALL SELECT 'theta', CAST(range AS INTEGER), round(2 * pi() * range / 10, 6) FROM range(11) UNION ALL SELECT 'phi', CAST(range AS INTEGER), round(acos(1 - 2.0 * range / 5), 6) FROM range(6)")
def bin_edges(spark, d):
    rows = [(k, i, float(e)) for k, v in ge.edges().items() for i, e in enumerate(v)]
    return spark.createDataFrame(rows, "axis string, i int, edge double").select("axis", "i", r6("edge", "edge"))


_SP = PT + ", Y AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS r, CASE WHEN atan2(py, px) < 0 THEN atan2(py, px) + 2 * pi() ELSE atan2(py, px) END AS th, acos(pz / sqrt(px * px + py * py + pz * pz)) AS ph FROM T)"
_IN = lambda x, e, n: f"CAST(greatest(len(list_filter(list_transform(range({n}), lambda i: {e}), lambda e: e < {x})) - 1, 0) AS INTEGER)"


@query(f"WITH {_SP} SELECT l_orderkey, l_linenumber, {_r('r')} AS r, {_r('th')} AS theta, {_r('ph')} AS phi, {_IN('r', 'power(3375.0 * i / 5, 1.0 / 3)', 6)} AS rb, {_IN('th', '2 * pi() * i / 10', 11)} AS tb, {_IN('ph', 'acos(1 - 2.0 * i / 5)', 6)} AS pb FROM Y")
def spherical_bins(spark, d):
    e = ge.edges()
    x = points(spark, d).select("l_orderkey", "l_linenumber", ge.spherical(F.col("p")).alias("s"))
    bins = [ge.interval(F.col(f"s.{k}"), e[k]).alias(n) for k, n in (("r", "rb"), ("theta", "tb"), ("phi", "pb"))]
    return x.select("l_orderkey", "l_linenumber", r6("s.r", "r"), r6("s.theta", "theta"), r6("s.phi", "phi"), *bins)


@query(f"WITH {PT} SELECT l_orderkey, l_linenumber, {_r('sqrt(power(least(abs(psi - phi), 2 * pi() - abs(psi - phi)), 2) + power(least(abs(0.5 - psi), 2 * pi() - abs(0.5 - psi)), 2))')} AS dist FROM T")
def torus_distance(spark, d):
    return points(spark, d).select("l_orderkey", "l_linenumber", r6(ge.torus_distance(F.col("phi"), F.col("psi"), F.col("psi"), F.lit(0.5)), "dist"))


_N = lambda x, y, z: f"sqrt({x}*{x} + {y}*{y} + {z}*{z})"
_FR = PT + f""", F1 AS (SELECT *, (sx-qx) / {_N('(sx-qx)', '(sy-qy)', '(sz-qz)')} AS zx, (sy-qy) / {_N('(sx-qx)', '(sy-qy)', '(sz-qz)')} AS zy, (sz-qz) / {_N('(sx-qx)', '(sy-qy)', '(sz-qz)')} AS zz, ux-qx AS nx, uy-qy AS ny, uz-qz AS nz FROM T),
 F2 AS (SELECT *, nx - zx*(nx*zx+ny*zy+nz*zz) AS vx, ny - zy*(nx*zx+ny*zy+nz*zz) AS vy, nz - zz*(nx*zx+ny*zy+nz*zz) AS vz FROM F1), F3 AS (SELECT *, vx / {_N('vx', 'vy', 'vz')} AS ax, vy / {_N('vx', 'vy', 'vz')} AS ay, vz / {_N('vx', 'vy', 'vz')} AS az, px-qx AS dx, py-qy AS dy, pz-qz AS dz FROM F2)"""


@query(f"WITH {_FR} SELECT l_orderkey, l_linenumber, {_r('dx*ax+dy*ay+dz*az')} AS x, {_r('dx*(zy*az-zz*ay)+dy*(zz*ax-zx*az)+dz*(zx*ay-zy*ax)')} AS y, {_r('dx*zx+dy*zy+dz*zz')} AS z FROM F3")
def local_frame(spark, d):
    x = points(spark, d).select("l_orderkey", "l_linenumber", ge.in_frame(F.col("p"), F.col("q"), F.col("s"), F.col("u")).alias("f"))
    return x.select("l_orderkey", "l_linenumber", r6("f.x", "x"), r6("f.y", "y"), r6("f.z", "z"))


_VB = PT + ", W1 AS (SELECT *, qx-px AS bx, qy-py AS by_, qz-pz AS bz, sx-qx AS cx, sy-qy AS cy, sz-qz AS cz FROM T)"


@query(f"WITH {_VB} SELECT l_orderkey, l_linenumber, {_r('-0.58273431*(by_*cz-bz*cy)+0.56802827*bx-0.54067466*cx+qx')} AS x, {_r('-0.58273431*(bz*cx-bx*cz)+0.56802827*by_-0.54067466*cy+qy')} AS y, {_r('-0.58273431*(bx*cy-by_*cx)+0.56802827*bz-0.54067466*cz+qz')} AS z FROM W1")
def virtual_cb(spark, d):
    x = points(spark, d).select("l_orderkey", "l_linenumber", ge.virtual_beta(F.col("p"), F.col("q"), F.col("s")).alias("f"))
    return x.select("l_orderkey", "l_linenumber", r6("f.x", "x"), r6("f.y", "y"), r6("f.z", "z"))


@query(f"WITH {_VB} SELECT resname, round(avg(CASE WHEN resname = 'GLY' THEN -0.58273431*(by_*cz-bz*cy)+0.56802827*bx-0.54067466*cx+qx ELSE ux END), 4) AS x FROM W1 GROUP BY resname")
def gly_branch(spark, d):
    cb = F.when(F.col("resname") == "GLY", ge.virtual_beta(F.col("p"), F.col("q"), F.col("s"))).otherwise(F.col("u"))
    return points(spark, d).select("resname", cb["x"].alias("x")).groupBy("resname").agg(F.round(F.avg("x"), 4).alias("x"))


_DI = PT + """, D1 AS (SELECT *, qx-px AS ax, qy-py AS ay, qz-pz AS az, sx-qx AS bx, sy-qy AS by_, sz-qz AS bz, ux-sx AS cx, uy-sy AS cy, uz-sz AS cz FROM T),
 D2 AS (SELECT *, ay*bz-az*by_ AS mx, az*bx-ax*bz AS my, ax*by_-ay*bx AS mz, by_*cz-bz*cy AS nx, bz*cx-bx*cz AS ny, bx*cy-by_*cx AS nz FROM D1)"""


@query(f"WITH {_DI} SELECT l_orderkey, l_linenumber, CASE WHEN mx*mx+my*my+mz*mz > 0 AND nx*nx+ny*ny+nz*nz > 0 THEN round(atan2(((my*nz-mz*ny)*bx + (mz*nx-mx*nz)*by_ + (mx*ny-my*nx)*bz) / sqrt(bx*bx+by_*by_+bz*bz), mx*nx+my*ny+mz*nz), 5) + 0.0 END AS angle FROM D2")
def dihedral_angle(spark, d):
    return points(spark, d).select("l_orderkey", "l_linenumber", (F.round(ge.dihedral(F.col("p"), F.col("q"), F.col("s"), F.col("u")), 5) + 0.0).alias("angle"))


@query(f"WITH {PT} SELECT l_orderkey, l_linenumber, {_r('sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz)+1e-10)')} AS dist FROM T")
def pair_distance(spark, d):
    return points(spark, d).select("l_orderkey", "l_linenumber", r6(ge.distance(F.col("p"), F.col("q")), "dist"))


@query("SELECT l_orderkey, l_linenumber, round((0.3178780674934387 * l_quantity - ln(0.2689192327152678)) / ln(2), 6) AS bits FROM lineitem")
def bitscore(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(ve.bit_score(F.col("l_quantity"), F.lit(0.3178780674934387), F.lit(0.2689192327152678)), "bits"))


@query("SELECT CAST(((s.range * 5 + r.range) * 10 + t.range) * 5 + p.range AS INTEGER) AS bin_id, ['B', 'L', 'R', 'X'][s.range + 1] AS ss, CAST(r.range AS INTEGER) AS r, CAST(t.range AS INTEGER) AS t, CAST(p.range AS INTEGER) AS p FROM range(4) s, range(5) r, range(10) t, range(5) p")
def bin_catalogue(spark, d):
    x = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in ge.CLASSES])).alias("ss"))
    for k, n in (("r", ge.N_R), ("t", ge.N_THETA), ("p", ge.N_PHI)):
        x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(k))
    return x.select(ge.bin_id(F.col("ss"), F.col("r"), F.col("t"), F.col("p")).alias("bin_id"), "ss", "r", "t", "p")


@query(f"WITH {V} SELECT a.id AS a, b.id AS b, round({jac('a.vec', 'b.vec')}, 6) AS sim FROM V a JOIN V b ON a.id < b.id WHERE {jac('a.vec', 'b.vec')} >= 0.35")
def jaccard_pairs(spark, d):
    return vo.similar_pairs(vectors(spark, d), 0.35).select("a", "b", r6("sim", "sim"))


@query(f"WITH {V}, E AS (SELECT a.id AS x, b.id AS y, round({jac('a.vec', 'b.vec')}, 6) AS sim FROM V a JOIN V b ON a.id <> b.id WHERE {jac('a.vec', 'b.vec')} >= 0.3), K AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS n FROM E) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, sim FROM K WHERE n <= 20")
def knn_graph(spark, d):
    return vo.nearest_neighbours(vectors(spark, d), 0.3, 20)


@query(f"WITH {V} SELECT cluster, CASE WHEN sim >= 0.3 THEN 'edge' ELSE 'none' END AS kind, count(*) AS n FROM (SELECT a.cluster, round({jac('a.vec', 'b.vec')}, 6) AS sim FROM V a JOIN V b ON a.cluster = b.cluster AND a.id < b.id) GROUP BY ALL")
def similarity_floor(spark, d):
    return vo.pairs_over(vectors(spark, d), 0.3)


_CM = V + ", CM AS (SELECT cluster, i, median(vec[i]) AS m FROM V, range(1, 65) t(i) GROUP BY cluster, i), CC AS (SELECT cluster AS centre_id, list(m ORDER BY i) AS centre FROM CM GROUP BY cluster)"


def _centres(spark, d):
    m = vo.cluster_median(vectors(spark, d)).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "median"))).alias("m"))
    return m.select(F.col("cluster").alias("centre_id"), F.transform("m", lambda x: x["median"]).alias("centre"))


@query(f"WITH {_CM} SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS median FROM CM")
def cluster_median(spark, d):
    return vo.cluster_median(vectors(spark, d)).select("cluster", "dim", r6("median", "median"))


_NC = _CM + f", J AS (SELECT id, centre_id, round({jac('vec', 'centre')}, 9) AS sim FROM V CROSS JOIN CC)"


@query(f"WITH {_NC} SELECT id, centre_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, centre_id) AS n FROM J) WHERE n = 1")
def nearest_centroid(spark, d):
    x = rl.best_centre(vectors(spark, d), _centres(spark, d), F.round(ve.weighted_jaccard(F.col("vec"), F.col("centre")), 9))
    return x.select("id", "centre_id", r6("sim", "sim"))


@query(f"WITH {_NC} SELECT id, centre_id, round(sim, 6) AS sim FROM (SELECT *, max(sim) OVER (PARTITION BY id) AS top FROM J) WHERE sim = top")
def centroid_join(spark, d):
    x = rl.best_centre(vectors(spark, d), _centres(spark, d), F.round(ve.weighted_jaccard(F.col("vec"), F.col("centre")), 9), ties=True)
    return x.select("id", "centre_id", r6("sim", "sim"))


@query(f"WITH {V}, D AS (SELECT a.cluster, a.id, round(sum(1 - coalesce({jac('a.vec', 'b.vec')}, 0)), 9) AS far FROM V a JOIN V b USING (cluster) GROUP BY 1, 2) SELECT cluster, id AS medoid, round(far, 6) AS far FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY far, id) AS n FROM D) WHERE n = 1")
def cluster_medoid(spark, d):
    return vo.cluster_medoid(vectors(spark, d)).select("cluster", "medoid", r6("far", "far"))


_JS = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: least({a}[i], {b}[i]))) / list_sum(list_transform(range(1, 65), lambda i: greatest({a}[i], {b}[i])))"


@query(f"WITH {_NC} SELECT id, centre_id, CAST(least(floor(sim * 100), 99) AS INTEGER) AS bin, CAST(CASE WHEN sim <= 0 THEN 0 ELSE greatest(ceil(sim * 100), 1) * 3 - 20 END AS INTEGER) AS score FROM J")
def jaccard_bin_score(spark, d):
    x = vectors(spark, d).crossJoin(F.broadcast(_centres(spark, d))).select("id", "centre_id", F.round(ve.weighted_jaccard(F.col("vec"), F.col("centre")), 9).alias("sim"))
    scores = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i * 3 - 20)
    return x.select("id", "centre_id", ve.similarity_bin(F.col("sim")).alias("bin"), ve.similarity_score(F.col("sim"), scores).alias("score"))


@query("WITH X AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS sim FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN sim <= 0 THEN 0 ELSE greatest(ceil(sim * 100), 1) - 50 END AS INTEGER) AS score FROM X")
def score_lookup(spark, d):
    scores = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i - 50)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ve.similarity_score(F.col("l_discount") * 10, scores).alias("score"))


@query("WITH X AS (SELECT p_type AS cluster, p_size / 8.0 - 3 AS phi, (p_retailprice - floor(p_retailprice / 6) * 6) - 3 AS psi FROM part), BN AS (SELECT DISTINCT cluster, round(phi * 5) / 5 AS phi, round(psi * 5) / 5 AS psi FROM X) "
       "SELECT a.cluster AS a, b.cluster AS b, round(avg(sqrt(power(least(abs(b.phi - a.phi), 2 * pi() - abs(b.phi - a.phi)), 2) + power(least(abs(b.psi - a.psi), 2 * pi() - abs(b.psi - a.psi)), 2))), 6) AS dist FROM BN a CROSS JOIN BN b GROUP BY 1, 2")
def cluster_cross_avg(spark, d):
    x = read(spark, d, "part").selectExpr("p_type AS cluster", "p_size / 8.0D - 3 AS phi", "(p_retailprice - floor(p_retailprice / 6) * 6) - 3 AS psi")
    b = x.select("cluster", (F.round(F.col("phi") * 5) / 5).alias("phi"), (F.round(F.col("psi") * 5) / 5).alias("psi")).distinct()  # angle bins of a cluster
    a = b.toDF("a", "phi1", "psi1")
    return a.crossJoin(b.toDF("b", "phi2", "psi2")).groupBy("a", "b").agg(r6(F.avg(ge.torus_distance(F.col("phi1"), F.col("psi1"), F.col("phi2"), F.col("psi2"))), "dist"))


@query("WITH M AS (SELECT l_linenumber AS r, l_returnflag AS ss, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2) SELECT r, ss, round(mean, 6) AS mean, round((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()), 6) AS scaled FROM M")
def dimension_rollup(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("r"), F.col("l_returnflag").alias("ss"), "l_quantity")
    return vo.rolled(x, ["r", "ss"], "l_quantity").select("r", "ss", r6("mean", "mean"), r6("scaled", "scaled"))


@query("SELECT vec_id, CAST(len(embedding) - 1 AS INTEGER) AS n, round(CAST(embedding[63] AS DOUBLE), 6) AS last FROM embeddings")
def drop_last_bin(spark, d):
    v = ve.without_last(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.size(v).alias("n"), r6(F.element_at(v, -1).cast("double"), "last"))


_ND = L + ", N AS (SELECT a.prot_id, a.pos, b.letter AS bin, count(*) AS cnt FROM L a JOIN L b ON a.prot_id = b.prot_id WHERE abs(a.pos - b.pos) > 5 AND abs(a.value - b.value) < 5 GROUP BY ALL)"


@query(f"WITH {_ND} SELECT prot_id, pos, array_to_string(list_concat(list_transform(range(5), lambda k: CAST(coalesce(m[k], 0) AS VARCHAR)), ['5']), ',') AS vec FROM (SELECT prot_id, pos, map_from_entries(list((bin, cnt))) AS m FROM N GROUP BY prot_id, pos)")
def nhot_dense(spark, d):
    x = letters(spark, d)
    near = rl.near_values(x.select("prot_id", "pos", F.col("value").alias("at")), 5.0)
    n = ct.bin_counts(near.join(x.select("prot_id", F.col("pos").alias("nbr_pos"), F.col("letter").alias("bin_id")), ["prot_id", "nbr_pos"]))
    return ct.dense_bins(n, LETTERS).select("prot_id", "pos", F.array_join(F.transform("vec", lambda v: v.cast("string")), ",").alias("vec"))


@query("WITH X AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS a, CAST(round(l_discount * 100) AS INTEGER) + 1 AS b, CAST(round(l_tax * 100) AS INTEGER) + 1 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS col, CAST(CASE WHEN k < a THEN 3 + k WHEN k < a + b THEN NULL WHEN k < a + b + c THEN 3 + k - b END AS INTEGER) AS i, CAST(CASE WHEN k < a + b THEN k ELSE NULL END AS INTEGER) AS j FROM X, LATERAL (SELECT unnest(range(a + b + c)) AS k)")
def cigar_expand(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.round(F.col("l_discount") * 100).cast("int") + 1).cast("string"), F.lit("D"), (F.round(F.col("l_tax") * 100).cast("int") + 1).cast("string"), F.lit("I")).alias("cigar"))
    return sq.cigar_rows(x, sq.parsed_cigar(F.col("cigar")), F.lit(4), F.lit(1)).drop("cigar")


@query("SELECT l_orderkey, l_linenumber, list_transform(regexp_extract_all(c, '\\d+'), lambda x: CAST(x AS INTEGER))[1] AS first, len(regexp_extract_all(c, '[A-Z]')) AS ops FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'M2D1I' || l_linenumber || 'M' AS c FROM lineitem)")
def cigar_parse(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sq.parsed_cigar(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M2D1I"), F.col("l_linenumber").cast("string"), F.lit("M"))).alias("c"))
    return x.select("l_orderkey", "l_linenumber", F.col("c")[0]["len"].alias("first"), F.size("c").cast("long").alias("ops"))


@query("SELECT doc_id, reverse(translate(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g'), 'ACGT', 'TGCA')) AS rc FROM documents")
def fasta_revcomp(spark, d):
    s = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    return read(spark, d, "documents").select("doc_id", sq.reverse_complement(s).alias("rc"))


@query("WITH X AS (SELECT upper(coalesce(text, '')) AS t FROM documents) " + " UNION ALL ".join(f"SELECT '{c}' AS base, CAST(sum(length(t) - length(replace(t, '{c}', ''))) AS BIGINT) AS n FROM X" for c in "ACGT"))
def dna_base_counts(spark, d):
    t = F.upper(F.coalesce("text", F.lit("")))
    x = read(spark, d, "documents").agg(*[F.sum(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).alias(c) for c in "ACGT"])
    return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("base"), F.col(c).cast("long").alias("n")) for c in "ACGT"])).alias("x")).select("x.*")


@query()
def dna_cutoff(spark, d):
    n = {r.base: r.n for r in dna_base_counts(spark, d).collect()}  # four rows
    cut = kernels.dna_cutoff(n, None, sq.DNA_MATCH, sq.DNA_TRANSITION, -12, 0.05)
    return spark.createDataFrame([(cut,)], "cutoff long")


@query("WITH N AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x) SELECT a.x AS a, b.x AS b, CASE WHEN a.x = b.x THEN 10 ELSE -10 END AS score FROM N a, N b")
def dna_scores(spark, d):
    n = spark.createDataFrame([(c,) for c in "ACGT"], "a string")
    return n.crossJoin(n.withColumnRenamed("a", "b")).select("a", "b", sq.dna_score(F.col("a"), F.col("b")).alias("score"))


def _seqs(spark, d):
    """pair, x, y: letters of both proteins as arrays, and an alignment by place with every seventh place open."""
    s = F.sort_array(F.collect_list(F.struct("pos", "letter")))
    q = letters(spark, d).groupBy("prot_id").agg(F.transform(s, lambda v: v["letter"]).alias("x"))
    a = q.filter("prot_id % 2 = 0").select(F.expr("prot_id div 2").alias("pair"), "x")
    b = q.filter("prot_id % 2 = 1").select(F.expr("prot_id div 2").alias("pair"), F.col("x").alias("y"))
    return a.join(b, "pair").withColumn("aln", F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.when((i % 7 == 6) | (i + 1 >= F.size("y")), -1).otherwise(i + F.when(i > 10, 1).otherwise(0))))


_PJ = P + ", NX AS (SELECT prot_id // 2 AS pair, pos, letter FROM L WHERE prot_id % 2 = 0 AND prot_id + 1 IN (SELECT prot_id FROM L)), NY AS (SELECT prot_id // 2 AS pair, pos, letter FROM L WHERE prot_id % 2 = 1), LN AS (SELECT pair, count(*) AS n FROM NY GROUP BY pair), A AS (SELECT NX.pair, NX.pos, NX.letter AS a, CASE WHEN NX.pos % 7 = 6 OR NX.pos + 1 >= n THEN -1 ELSE NX.pos + CASE WHEN NX.pos > 10 THEN 1 ELSE 0 END END AS j FROM NX JOIN LN USING (pair))"


@query(f"""WITH {_PJ}, X AS (SELECT pair, pos, j, lag(j) OVER (PARTITION BY pair ORDER BY pos) AS before FROM A),
 R AS (SELECT pair, pos, 0 AS own, CAST(NULL AS INTEGER) AS i, unnest(range(before + 1, j)) AS j FROM X WHERE before >= 0 AND j > before + 1 UNION ALL SELECT pair, pos, 1, pos, CASE WHEN j >= 0 THEN j END FROM X)
 SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY pos, own, j) - 1 AS INTEGER) AS col, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM R""")
def gapped_columns(spark, d):
    x = _seqs(spark, d).select("pair", F.posexplode(sq.gapped_columns(F.col("aln"))).alias("col", "c"))
    return x.select("pair", "col", "c.i", "c.j")



@query(f"WITH {_PJ} SELECT A.pair, A.pos AS i, A.a AS letter1, NY.letter AS letter2 FROM A LEFT JOIN NY ON NY.pair = A.pair AND NY.pos = A.j")
def project_letters(spark, d):
    x = _seqs(spark, d).withColumn("c", F.filter(sq.gapped_columns(F.col("aln")), lambda c: c["i"].isNotNull()))
    x = x.select("pair", F.arrays_zip("c", sq.projected(F.col("c"), F.col("x"), "i").alias("a"), sq.projected(F.col("c"), F.col("y"), "j").alias("b")).alias("z"))
    return x.select("pair", F.explode("z").alias("z")).select("pair", F.col("z.c.i").alias("i"), F.col("z.a").alias("letter1"), F.col("z.b").alias("letter2"))


@query(f"WITH {L} SELECT prot_id, pos, CAST(k AS INTEGER) AS k, CAST(CASE WHEN k = letter THEN 1 ELSE 0 END AS INTEGER) AS v FROM L, range(5) t(k)")
def one_hot(spark, d):
    return letters(spark, d).select("prot_id", "pos", F.posexplode(sq.one_hot(F.col("letter"), LETTERS)).alias("k", "v"))


_GS = _PJ + """, Z AS (SELECT A.pair, A.pos, A.a, NY.letter AS b, NY.letter IS NULL AS gap FROM A LEFT JOIN NY ON NY.pair = A.pair AND NY.pos = A.j),
 Y AS (SELECT *, lag(gap) OVER (PARTITION BY pair ORDER BY pos) AS before FROM Z)"""


@query(f"WITH {_GS} SELECT pair, round(sum(CASE WHEN gap AND coalesce(before, false) THEN -1.0 WHEN gap THEN -5.0 WHEN a = 4 OR b = 4 THEN 0.0 WHEN a = b THEN 4.0 ELSE -1.5 END) / count(*) FILTER (gap OR NOT (a = 4 OR b = 4)), 6) AS score FROM Y GROUP BY pair")
def gapped_score(spark, d):
    x = _seqs(spark, d).withColumn("c", F.filter(sq.gapped_columns(F.col("aln")), lambda c: c["i"].isNotNull()))
    x = x.select("pair", sq.projected(F.col("c"), F.col("x"), "i").alias("a"), sq.projected(F.col("c"), F.col("y"), "j").alias("b"))
    score = sq.gapped_score(F.col("a"), F.col("b"), lambda p, q: F.when(p == q, 4.0).otherwise(-1.5), -5.0, -1.0, 4)
    return x.select("pair", r6(score, "score"))


@query("SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS label FROM pages")
def path_label(spark, d):
    return read(spark, d, "pages").select("page_id", sq.path_label(F.col("url")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(t) >= 5 THEN left(t, 4) || repeat('X', least(length(t), 12) - 4) || substr(t, 13) ELSE t END AS masked FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def mask_range(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return x.select("doc_id", sq.masked(F.col("t"), F.lit(5), F.lit(12)).alias("masked"))


@query(f"WITH {B} SELECT x.prot_id // 2 AS pair, x.pos AS i, y.pos AS j, S.score FROM L x JOIN L y ON y.prot_id = x.prot_id + 1 JOIN S ON S.a = x.letter AND S.b = y.letter WHERE x.prot_id % 2 = 0")
def sim_matrix(spark, d):
    m = ct.substitution_scores(ct.pair_counts(aligned(spark, d)), LETTERS)
    return _similarity(spark, d, m).select("pair", "i", "j", "score")


def _similarity(spark, d, m):
    x = letters(spark, d).withColumn("pair", F.expr("prot_id div 2"))
    one = x.filter("prot_id % 2 = 0").select("pair", F.col("pos").alias("i"), F.col("letter").alias("a"), F.col("value").alias("va"))
    two = x.filter("prot_id % 2 = 1").select("pair", F.col("pos").alias("j"), F.col("letter").alias("b"), F.col("value").alias("vb"))
    return one.join(two, "pair").join(F.broadcast(m), ["a", "b"])  # an alphabet's square


@query(f"WITH {B} SELECT x.prot_id // 2 AS pair, x.pos AS i, y.pos AS j, round(0.6::DOUBLE * S.score + 0.4::DOUBLE * CASE WHEN floor(x.value / 25) = floor(y.value / 25) THEN 3 ELSE -1 END, 6) AS score FROM L x JOIN L y ON y.prot_id = x.prot_id + 1 JOIN S ON S.a = x.letter AND S.b = y.letter WHERE x.prot_id % 2 = 0")
def combo_similarity(spark, d):
    m = ct.substitution_scores(ct.pair_counts(aligned(spark, d)), LETTERS)
    second = F.when(F.floor(F.col("va") / 25) == F.floor(F.col("vb") / 25), 3).otherwise(-1)
    return _similarity(spark, d, m).select("pair", "i", "j", r6(0.6 * F.col("score") + 0.4 * second, "score"))


@query(f"WITH {V} SELECT a.id AS a, b.id AS b, round({jac('a.vec', 'b.vec')}, 6) AS sim FROM V a JOIN V b ON b.id = a.id + 1")
def blurry_similarity(spark, d):
    v = vectors(spark, d)
    p = v.select(F.col("id").alias("a"), F.col("vec").alias("va")).withColumn("b", F.col("a") + 1).join(v.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    return p.select("a", "b", r6(ve.weighted_jaccard(F.col("va"), F.col("vb")), "sim"))


# Functions called from SQL text.


def _called(spark, text, **tables):
    """The rows of a statement that may call the registered functions."""
    surface.register(spark)
    return spark.sql(text, **tables)


@query(f"WITH {V} SELECT a.id AS a, b.id AS b, round({jac('a.vec', 'b.vec')}, 6) AS sim FROM V a JOIN V b ON b.id = a.id + 1")
def sql_jaccard(spark, d):
    return _called(spark, "SELECT a.id AS a, b.id AS b, round(jaccard(a.vec, b.vec), 6) + 0.0D AS sim FROM {v} a JOIN {v} b ON b.id = a.id + 1", v=vectors(spark, d))


@query("SELECT l_orderkey, l_linenumber, round((0.3178780674934387 * l_quantity - ln(0.2689192327152678)) / ln(2), 6) AS bits FROM lineitem")
def sql_bitscore(spark, d):
    text = "SELECT l_orderkey, l_linenumber, round(bitscore(l_quantity, 0.3178780674934387D, 0.2689192327152678D), 6) + 0.0D AS bits FROM {x}"
    return _called(spark, text, x=read(spark, d, "lineitem"))


@query("WITH X AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS m FROM lineitem), O AS (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS op, m FROM X) SELECT l_orderkey, l_linenumber, CAST(op AS INTEGER) AS op, ['M', 'D', 'I'][op + 1] AS kind, CAST([m, 2, l_linenumber][op + 1] AS INTEGER) AS len, CAST(3 + CASE WHEN op > 0 THEN m ELSE 0 END AS INTEGER) AS first1, CAST(CASE WHEN op > 0 THEN m ELSE 0 END + CASE WHEN op > 1 THEN 2 ELSE 0 END AS INTEGER) AS first2 FROM O")
def sql_parse_cigar(spark, d):
    text = "SELECT l_orderkey, l_linenumber, c.* FROM {x}, LATERAL parse_cigar(concat(int(l_quantity), 'M2D', l_linenumber, 'I'), 4, 1) c"
    return _called(spark, text, x=read(spark, d, "lineitem"))


@query(ORACLE["gapped_columns"])
def sql_expand_alignment(spark, d):
    return _called(spark, "SELECT pair, c.* FROM {x}, LATERAL expand_alignment(aln) c", x=_seqs(spark, d).select("pair", "aln"))


# Alignment kernels, search, and learned alphabets.


def _matrix(spark, d) -> np.ndarray:
    return le.matrix_of(ct.substitution_scores(ct.pair_counts(aligned(spark, d)), LETTERS), LETTERS)


def _folded(spark, d):
    """prot_id, letters (two alphabets), coords: a helix whose pitch follows the values."""
    x = letters(spark, d)
    at = F.struct(F.col("pos"), F.col("letter"), F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("int").alias("second"), F.col("value").alias("v"))
    x = x.groupBy("prot_id").agg(F.sort_array(F.collect_list(at)).alias("s"))
    p = lambda s: F.struct((2.3 * F.cos(s["pos"] * math.radians(100))).alias("x"), (2.3 * F.sin(s["pos"] * math.radians(100))).alias("y"), (1.5 * s["pos"] + s["v"] / 50).alias("z"))
    return x.select("prot_id", F.array(F.transform("s", lambda s: s["letter"]), F.transform("s", lambda s: s["second"])).alias("letters"), F.transform("s", p).alias("coords"))


def _pairs(spark, d):
    f = _folded(spark, d).select("prot_id").filter("prot_id % 2 = 0")
    return f.select(F.col("prot_id").alias("prot1"), (F.col("prot_id") + 1).alias("prot2"))


def _second(spark, d) -> np.ndarray:
    return np.where(np.eye(LETTERS, dtype=bool), 3.0, -1.0)


@query(f"""WITH {L}, B AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM L GROUP BY letter), S AS (SELECT sum(p * p) AS s FROM B)
 SELECT 'events' AS alphabet, round(ln((1 - s) / s), 5) AS lam, round((1 - 2 * s) * (1 - 2 * s) / (1 - s), 5) AS k FROM S""")
def karlin(spark, d):
    """A match scores 1, another pair -1, over the letters' frequencies: lambda and K have a closed form."""
    back = ct.background(letters(spark, d))
    other = back.select(F.col("letter").alias("b"))
    matrix = back.select(F.col("letter").alias("a")).join(other, F.col("a") <= F.lit(LETTERS)).withColumn("score", F.when(F.col("a") == F.col("b"), 1).otherwise(-1))
    found = al.karlin_parameters(ct.score_distribution(back, matrix).withColumn("alphabet", F.lit("events")))
    return found.select("alphabet", F.round("lam", 5).alias("lam"), F.round("k", 5).alias("k"))


@query()
def sw_align(spark, d):
    pairs = al.with_proteins(_pairs(spark, d), _folded(spark, d))
    return al.align_pairs(pairs, [_matrix(spark, d), _second(spark, d)], [0.5, 0.5], open_=-4.0, extend=-1.0)


@query()
def search_hits(spark, d):
    p = _folded(spark, d)
    queries = p.filter("prot_id % 20 = 0").select("prot_id")  # the stated query set
    return al.search(queries, p, [_matrix(spark, d), _second(spark, d)], weights=[0.5, 0.5], open_=-4.0, extend=-1.0)


def _counted(spark, d):
    """prot_id, letters (counts of the letters up to two places away, and one off the map), coords."""
    p = _folded(spark, d).withColumn("l", F.col("letters")[0])
    near = lambda i: F.slice("l", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3)
    counts = lambda i: F.transform(F.sequence(F.lit(0), F.lit(LETTERS)), lambda k: F.when(k == LETTERS, 1.0).otherwise(F.size(F.filter(near(i), lambda x: x == k)).cast("double")))
    return p.select("prot_id", F.transform("l", lambda _, i: counts(i)).alias("letters"), "coords")


def _blur(spark, d) -> np.ndarray:
    """Transitions between aligned letters; the place off the map stays."""
    edges = aligned(spark, d).select(F.col("a").alias("bin1"), F.col("b").alias("bin2"))
    pairs, _ = ct.edge_bins(edges, LETTERS)
    out = np.eye(LETTERS + 1)
    for r in ct.transitions(pairs).collect():  # the square of the letters and one
        out[r.a, r.b] = r.p
    return out


#: A score for each hundredth of the similarity.
_JACCARD_SCORES = np.arange(1, 101) / 10 - 7


@query()
def blurry_search(spark, d):
    """Hits by count vectors that the transition matrix blurs."""
    p = _counted(spark, d)
    return al.search(p.filter("prot_id % 20 = 0").select("prot_id"), p, [_blur(spark, d)], karlins=[(0.497953, 0.203836)], open_=-4.0, extend=-1.0, scores=_JACCARD_SCORES)


@query()
def blurry_grid(spark, d):
    pairs = al.with_proteins(_pairs(spark, d), _counted(spark, d))
    return al.grid_search(pairs, [_blur(spark, d)], [-6.0, -4.0], [-1.5, -0.5], scores=_JACCARD_SCORES)


@query()
def grid_align(spark, d):
    pairs = al.with_proteins(_pairs(spark, d), _folded(spark, d))
    return al.grid_search(pairs, [_matrix(spark, d), _second(spark, d)], [-6.0, -4.0], [-1.5, -0.5], [[0.3, 0.7], [0.5, 0.5]])


@query()
def scheme_max(spark, d):
    """The best scheme of each pair of users, over soft one-hot vectors."""
    p = _folded(spark, d)
    soft = F.transform(F.col("letters")[0], lambda a: F.transform(F.sequence(F.lit(0), F.lit(LETTERS - 1)), lambda k: F.when(k == a, 1.0).otherwise(0.2)))
    held = p.select("prot_id", soft.alias("vecs"), "coords")
    pairs = _pairs(spark, d)
    for n in ("1", "2"):
        pairs = pairs.join(held.toDF(f"prot{n}", f"vecs{n}", f"coords{n}"), f"prot{n}")
    x = al.scheme_search(pairs, [(m, s, o) for m in (2.0, 5.0) for s in (0.3, 0.5) for o in (-2.0,)])
    return x.groupBy("prot1", "prot2").agg(F.max("lddt").alias("lddt"), F.max_by("scheme", F.struct("lddt", -F.col("scheme"))).alias("scheme"))


@query()
def scheme_calibration(spark, d):
    """Votes for each scheme, over the pairs' count vectors, blurred by the transitions between aligned letters."""
    held, pairs = _counted(spark, d).withColumnRenamed("letters", "vecs"), _pairs(spark, d)
    for n in ("1", "2"):
        pairs = pairs.join(held.toDF(f"prot{n}", f"vecs{n}", f"coords{n}"), f"prot{n}")
    x = al.scheme_search(pairs, al.CALIBRATION, -1.0, _blur(spark, d))
    return rk.scheme_votes(x.select(F.struct("prot1", "prot2").alias("pair"), "scheme", F.col("lddt").alias("value"))).select("scheme", r6("votes", "votes"))


@query()
def mi_merge(spark, d):
    """Angle bins merged into letters by mutual information of consecutive items."""
    x = points(spark, d).select("l_orderkey", "l_linenumber", (ge.angle_bin(F.col("phi"), 5) * 5 + ge.angle_bin(F.col("psi"), 5)).alias("a"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    n = ct.pair_counts(x.select("a", F.lead("a").over(w).alias("b")).filter("b is not null"))
    joint = np.zeros((30, 30))
    for r in n.collect():  # the square of 30 bins
        joint[r.a % 30, r.b % 30] += r.n
    seen = np.flatnonzero(joint.sum(axis=0) + joint.sum(axis=1))
    touch = le.torus_adjacent(5)
    groups = le.merged_bins(joint[np.ix_(seen, seen)] + 1e-9, lambda p, q: touch({int(seen[i]) for i in p}, {int(seen[i]) for i in q}), 8)
    return spark.createDataFrame([(int(seen[i]), k) for k, g in enumerate(groups) for i in g], "bin long, letter long")


@query()
def louvain(spark, d):
    v = vectors(spark, d)
    return le.graph_communities(knn_graph(spark, d), v.select("id"), [1.3, 4.0])


def _partners(spark, d):
    v = vectors(spark, d)
    return v.select(F.col("id"), F.col("vec").alias("x")).join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("y")), "id").select("x", "y")


@query()
def vq_encode(spark, d):
    book, _ = le.trained_codebook(_partners(spark, d))
    return le.encoded(vectors(spark, d), book)


@query()
def mi_centres(spark, d):
    c = le.learned_centres(_partners(spark, d), 8)
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "centre_id long, centre array<double>")
