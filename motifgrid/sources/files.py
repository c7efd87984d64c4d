"""Readers and writers of structures, alignments, lists, reports, settings, arrays and FASTA."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.sequences import masked, parsed_alignment, path_label, residue_letter, reverse_complement
from ..operators.ordering import placed

#: Fields of an ATOM line (name, first place, length, type).
ATOM_FIELDS = (("atom", 13, 4, "string"), ("altloc", 17, 1, "string"), ("resname", 18, 3, "string"), ("chain", 22, 1, "string"), ("res_seq", 23, 4, "int"), ("icode", 27, 1, "string"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"))
#: Fixed value: length of a peptide bond at most.
BOND = 1.8
PAIR_SCHEMA = "c0 string, prot1 string, prot2 string, tm double, aln string"


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, model, line and the fields of all ATOM lines of structure files; model counts from 0."""
    lines = spark.read.text(path, wholetext=True).select(path_label(F.col("_metadata.file_path")).alias("prot_id"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.withColumn("model", F.sum(F.col("value").startswith("ENDMDL").cast("int")).over(W.partitionBy("prot_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    fields = [F.trim(F.substring("value", a, n)).cast(t).alias(k) for k, a, n, t in ATOM_FIELDS]
    return lines.filter(F.substring("value", 1, 6) == "ATOM  ").select("prot_id", "model", "line", *fields)


def residues(spark: SparkSession, path: str) -> DataFrame:
    """One row a residue: prot_id, model, chain, pos, resname, letter, n, ca, c, cb (virtual for GLY), phi, psi, ss.

    Residues without N, CA or C have null angles; the first and last of a chain are X, as are those at a break: no
    peptide bond joins a C to an N that is BOND or more away.
    """
    a = atoms(spark, path).withColumn("at", F.struct("x", "y", "z"))
    key = ["prot_id", "model", "chain", "res_seq", "icode"]
    at = [F.min_by(F.when(F.col("atom") == k, F.col("at")), F.when(F.col("atom") == k, F.col("line"))).alias(k.lower()) for k in ("N", "CA", "C", "CB")]
    r = a.groupBy(*key).agg(F.min("line").alias("first"), F.min_by("resname", "line").alias("resname"), *at)
    r = r.withColumn("pos", F.row_number().over(W.partitionBy("prot_id").orderBy("first")) - 1)
    r = r.withColumn("cb", F.when(F.col("resname") == "GLY", g.virtual_beta(F.col("n"), F.col("ca"), F.col("c"))).otherwise(F.col("cb")))
    chain = W.partitionBy("prot_id", "model", "chain").orderBy("first")
    before, after = F.lag("c").over(chain), F.lead("n").over(chain)
    bonded = lambda c, n, x: F.when(g.distance(c, n) < BOND, x)
    before, after = bonded(before, F.col("n"), before), bonded(F.col("c"), after, after)
    r = r.withColumn("phi", g.dihedral(before, F.col("n"), F.col("ca"), F.col("c"))).withColumn("psi", g.dihedral(F.col("n"), F.col("ca"), F.col("c"), after))
    r = r.withColumn("ss", F.when(F.col("phi").isNull() | F.col("psi").isNull(), "X").otherwise(g.structure_class(F.col("phi"), F.col("psi"))))
    return r.select("prot_id", "model", "chain", "pos", "resname", residue_letter(F.col("resname")).alias("letter"), "n", "ca", "c", "cb", "phi", "psi", "ss")


def residue_sequence(res: DataFrame) -> DataFrame:
    """prot_id, sequence."""
    held = F.sort_array(F.collect_list(F.struct("pos", "letter")))
    return res.groupBy("prot_id").agg(F.array_join(F.transform(held, lambda x: x["letter"]), "").alias("sequence"))


def backbone_angles(res: DataFrame) -> DataFrame:
    """prot_id, pos, resname, phi, psi of model 0, without missing or zero angles."""
    return res.filter((F.col("model") == 0) & F.col("phi").isNotNull() & F.col("psi").isNotNull() & (F.col("phi") != 0) & (F.col("psi") != 0)).select("prot_id", "pos", "resname", "phi", "psi")


def neighbourhoods(res: DataFrame, distance: float = 14.85, apart: int = 5) -> DataFrame:
    """prot_id, pos, nbr_pos, ss, r, t, p, bin_id: neighbours in each residue's frame, binned."""
    from ..operators.relations import cell_neighbours

    have = res.filter(F.col("ca").isNotNull() & F.col("cb").isNotNull() & F.col("n").isNotNull())
    near = cell_neighbours(have.select("prot_id", "pos", "ca.x", "ca.y", "ca.z"), distance, apart)
    own = have.select("prot_id", "pos", "ca", "cb", "n")
    other = have.select("prot_id", F.col("pos").alias("nbr_pos"), F.col("ca").alias("q"), "ss")
    d = near.join(own, ["prot_id", "pos"]).join(other, ["prot_id", "nbr_pos"])
    d = d.withColumn("s", g.spherical(g.in_frame(F.col("q"), F.col("ca"), F.col("cb"), F.col("n"))))
    e = g.edges()
    d = d.select("prot_id", "pos", "nbr_pos", "ss", *[g.interval(F.col(f"s.{k}"), e[k]).alias(n) for k, n in (("r", "r"), ("theta", "t"), ("phi", "p"))])
    return d.withColumn("bin_id", g.bin_id(F.col("ss"), F.col("r"), F.col("t"), F.col("p")))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """prot1, prot2, tm, aln of an alignment table with a header; rows that don't parse go, the last of repeated pairs stays."""
    lines = spark.read.schema(PAIR_SCHEMA).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    d = lines.select("prot1", "prot2", "tm", parsed_alignment(F.col("aln")).alias("aln"), F.monotonically_increasing_id().alias("__at")).filter("aln is not null")
    last = F.row_number().over(W.partitionBy("prot1", "prot2").orderBy(F.desc("__at")))
    return d.withColumn("__n", last).filter("__n = 1").drop("__n", "__at")


def cigars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prot1 string, prot2 string, start1 int, start2 int, cigar string").option("sep", "\t").csv(path)


def given_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prot1 string, prot2 string, lddt double").csv(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """prot_id: every cell of a list file."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("prot_id")).select(F.trim("prot_id").alias("prot_id")).filter("prot_id <> ''")


def write_names(rows: DataFrame, path: str) -> None:
    rows.select(rows.columns[0]).write.mode("overwrite").csv(path)


def write_chunks(rows: DataFrame, path: str) -> None:
    """Rows (name, chunk) into a folder for each chunk."""
    rows.write.mode("overwrite").partitionBy("chunk").csv(path)


def append_hits(hits: DataFrame, path: str) -> None:
    """Hits, in the order of rank, space-separated, a folder for each query list."""
    hits.sortWithinPartitions("query_list", "query", "rank").select("query_list", "query", "target", "prod", "lddt", "score").write.mode("append").partitionBy("query_list").option("sep", " ").csv(path)


def hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, target string, prod double, lddt double, score double").option("sep", " ").csv(path)


def classes(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p[0].alias("prot_id"), F.get(p, F.lit(1)).alias("fam")).filter("fam is not null")


def evaluation(spark: SparkSession, path: str) -> DataFrame:
    spec = "NAME string, SCOP string, FAM double, SFAM double, FOLD double, FP int, FAMCNT long, SFAMCNT long, FOLDCNT long"
    return spark.read.schema(spec).option("header", "true").option("sep", "\t").csv(path).orderBy("NAME")


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a small report file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).filter("value <> ''")


def settings(spark: SparkSession, path: str, kinds: dict[str, type] | None = None) -> dict:
    """key: value lines with exactly one colon; kinds: types by key; a bool is set only by True."""
    p = F.split("value", ":")
    rows = spark.read.text(path).filter(F.size(p) == 2).select(F.trim(p[0]), F.trim(p[1])).collect()  # one run's options
    typed = lambda k, v: v == "True" if (kinds or {}).get(k) is bool else (kinds or {}).get(k, str)(v)
    return {k: typed(k, v) for k, v in rows if (kinds or {}).get(k) is not bool or v == "True"}


def write_settings(runs: DataFrame, path: str) -> None:
    """One text file of `key: value` lines for each run; runs has run and options (map)."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    runs.select("run", lines.alias("value")).write.mode("overwrite").partitionBy("run").text(path)


def values_by_size(spark: SparkSession, path: str) -> DataFrame:
    """n, values from files named ...DIM<n>_s<seed>_params...; a value a line."""
    d = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"DIM(\d+)_s\d+_params", 1).alias("n"), F.col("value").try_cast("double").alias("v"))
    return d.filter("n <> ''").groupBy(F.col("n").cast("int").alias("n")).agg(F.sort_array(F.collect_list("v")).alias("values"))


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """prot_id, rows, cols, data (array<double>, row by row) of every array in .npz files; pickled objects are refused."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as held:
                    for k in held.files:
                        x = np.atleast_2d(held[k])
                        yield pa.RecordBatch.from_pylist([{"prot_id": k, "rows": x.shape[0], "cols": x.shape[1], "data": x.ravel().astype(float).tolist()}], schema=pa.schema([("prot_id", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "prot_id string, rows int, cols int, data array<double>")


def tensor_pairs(spark: SparkSession, path: str) -> DataFrame:
    """x, y of training pairs, shuffled by a seed."""
    return spark.read.schema("x array<float>, y array<float>").parquet(path).orderBy(F.rand(0))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (from 0, in the order of files and of records in them), header, sequence; white space and digits in sequences go.

    Records are read apart, so a large file is split among tasks; they are numbered by file and place, whatever the splits.
    """
    lines = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    d = placed(lines, "file", "block", "at", place="contig").select("contig", F.regexp_replace("value", r"\A>", "").alias("body"))
    head = F.regexp_extract("body", r"\A([^\n]*)", 1)
    return d.select("contig", F.trim(head).alias("header"), F.regexp_replace(F.substr("body", F.length(head) + 2), r"[\s\d]", "").alias("sequence"))


def fasta_range(records: DataFrame, first: int | None = None, last: int | None = None, reverse: bool = False, masks: DataFrame | None = None, ambiguous: str = "keep") -> DataFrame:
    """A sub-range (1-based), its reverse complement, and masked places (contig, a, b); ambiguous letters: keep, N or fail."""
    d = records
    if masks is not None:
        spans = masks.groupBy("contig").agg(F.collect_list(F.struct("a", "b")).alias("__m"))
        d = d.join(spans, "contig", "left").withColumn("sequence", F.aggregate(F.coalesce("__m", F.array().cast("array<struct<a:int,b:int>>")), F.col("sequence"), lambda s, m: masked(s, m["a"], m["b"]))).drop("__m")
    if ambiguous != "keep":
        odd = F.col("sequence").rlike("[^ACGTacgtXx]")
        d = d.withColumn("sequence", F.when(odd, F.raise_error(F.lit("an ambiguous letter"))).otherwise(F.col("sequence")) if ambiguous == "fail" else F.regexp_replace("sequence", "[^ACGTacgtXx]", "N"))
    if first is not None or last is not None:
        d = d.withColumn("sequence", F.substring("sequence", first or 1, (last or 2**31 - 1) - (first or 1) + 1))
    return d.withColumn("sequence", reverse_complement(F.col("sequence"))) if reverse else d
