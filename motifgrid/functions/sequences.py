"""Column expressions on letters, alignments, CIGAR strings, names and nucleotides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three-letter residue names and their letters, nucleotides and their complements.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
NUCLEOTIDES, COMPLEMENTS = "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"
DNA_MATCH, DNA_TRANSITION, DNA_TRANSVERSION = 10, -10, -10


def residue_letter(name: Column) -> Column:
    held = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.coalesce(F.try_element_at(held, F.upper(name)), F.lit("X"))


def parsed_alignment(text: Column) -> Column:
    """array<int> of "[0 1 -1 ...]"; null if a part isn't an integer."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(text, r"[\[\]]", "")), r"\s+"), lambda x: x != "")
    ints = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when(~F.exists(ints, lambda x: x.isNull()), ints)


def parsed_cigar(text: Column) -> Column:
    """array<struct<op, len>>."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)[A-Za-z]"), F.lit(1)), lambda x: x.cast("int"))
    return F.zip_with(F.regexp_extract_all(text, F.lit(r"\d+([A-Za-z])"), F.lit(1)), sizes, lambda o, n: F.struct(o.alias("op"), n.alias("len")))


def cigar_runs(ops: Column, start1: Column, start2: Column) -> Column:
    """array<struct<op, len, i, j, col>>: where each operation begins, from 1-based starts."""
    made = F.array().cast("array<struct<op:string,len:int,i:int,j:int,col:int>>")
    state = F.struct((start1 - 1).cast("int").alias("i"), (start2 - 1).cast("int").alias("j"), F.lit(0).alias("col"), made.alias("runs"))

    def step(s, o):
        n = F.greatest(o["len"], F.lit(0))
        run = F.struct(o["op"].alias("op"), n.alias("len"), s["i"].alias("i"), s["j"].alias("j"), s["col"].alias("col"))
        return F.struct((s["i"] + F.when(o["op"] != "D", n).otherwise(0)).alias("i"), (s["j"] + F.when(o["op"] != "I", n).otherwise(0)).alias("j"), (s["col"] + n).alias("col"), F.concat(s["runs"], F.array(run)).alias("runs"))

    return F.filter(F.aggregate(ops, state, step, lambda s: s["runs"]), lambda r: r["len"] > 0)


def cigar_columns(ops: Column, start1: Column, start2: Column) -> Column:
    """array<struct<i, j>> of alignment columns from 1-based starts; null is a gap (D in the first, I in the second)."""
    cell = lambda r, k: F.struct(F.when(r["op"] != "D", r["i"] + k).alias("i"), F.when(r["op"] != "I", r["j"] + k).alias("j"))
    return F.flatten(F.transform(cigar_runs(ops, start1, start2), lambda r: F.transform(F.sequence(F.lit(0), r["len"] - 1), lambda k: cell(r, k))))


def cigar_rows(df: DataFrame, ops: Column, start1: Column, start2: Column) -> DataFrame:
    """df with a row (col, i, j) for each alignment column: operations are exploded, then their columns."""
    d = df.select(*df.columns, F.explode(cigar_runs(ops, start1, start2)).alias("r")).select(*df.columns, "r", F.explode(F.sequence(F.lit(0), F.col("r.len") - 1)).alias("k"))
    at = lambda c: F.col(f"r.{c}") + F.col("k")
    return d.select(*df.columns, at("col").alias("col"), F.when(F.col("r.op") != "D", at("i")).alias("i"), F.when(F.col("r.op") != "I", at("j")).alias("j"))


def gapped_columns(aln: Column) -> Column:
    """array<struct<i, j>> of an alignment array: a jump in j opens a gap in the first, unless a gap precedes it."""
    empty = F.array().cast("array<struct<i:int,j:int>>")

    def columns(j, i):
        last = F.when(i > 0, F.get(aln, i - 1))
        skipped = F.when((last >= 0) & (j > last + 1), F.transform(F.sequence(last + 1, j - 1), lambda b: F.struct(F.lit(None).cast("int").alias("i"), b.alias("j")))).otherwise(empty)
        return F.concat(skipped, F.array(F.struct(i.alias("i"), F.when(j >= 0, j).alias("j"))))

    return F.flatten(F.transform(aln, columns))


def projected(columns: Column, letters: Column, side: str) -> Column:
    """Letters along alignment columns; null is a gap."""
    return F.transform(columns, lambda c: F.when(c[side].isNotNull(), F.get(letters, c[side])))


def one_hot(letter: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == letter).cast("int"))


def cells(aln: Column) -> Column:
    """array<struct<i, j>> of the aligned cells."""
    return F.filter(F.transform(aln, lambda j, i: F.struct(i.alias("i"), j.alias("j"))), lambda c: c["j"] >= 0)


def percent_identity(a: Column, b: Column, letters: list) -> Column:
    """Share of the columns where both sides hold the same of the given letters."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) & x.isin(letters), F.lit(False)).cast("int"))
    return F.try_divide(F.aggregate(same, F.lit(0), lambda s, x: s + x).cast("double"), F.size(same))


def gapped_score(a: Column, b: Column, score, first_gap: float, next_gap: float, unknown: int = -1) -> Column:
    """Score of gapped letters by length, with affine gaps; columns with the unknown letter don't count."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    state = F.struct(F.lit(False).alias("gap"), F.lit(0.0).alias("sum"), F.lit(0).alias("off"))

    def step(s, p):
        gap = p["x"].isNull() | p["y"].isNull()
        off = ~gap & ((p["x"] == unknown) | (p["y"] == unknown))
        add = F.when(gap, F.when(s["gap"], F.lit(float(next_gap))).otherwise(F.lit(float(first_gap)))).when(off, F.lit(0.0)).otherwise(score(p["x"], p["y"]).cast("double"))
        return F.struct(gap.alias("gap"), (s["sum"] + add).alias("sum"), (s["off"] + F.coalesce(off, F.lit(False)).cast("int")).alias("off"))

    return F.aggregate(pairs, state, step, lambda s: F.try_divide(s["sum"], F.size(pairs) - s["off"]))


def parent(level: Column) -> Column:
    """A dotted class without its last number."""
    return F.regexp_replace(level, r"\.\d+$", "")


def path_label(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, NUCLEOTIDES, COMPLEMENTS))


def masked(s: Column, first: Column, last: Column, by: str = "X") -> Column:
    """s with the 1-based places first to last masked, as far as they exist."""
    a, b = F.greatest(first, F.lit(1)), F.least(last, F.length(s))
    return F.when(b >= a, F.concat(F.substring(s, F.lit(1), a - 1), F.repeat(F.lit(by), b - a + 1), F.substring(s, b + 1, F.length(s)))).otherwise(s)


def dna_score(a: Column, b: Column, match: int = DNA_MATCH, transition: int = DNA_TRANSITION, transversion: int = DNA_TRANSVERSION) -> Column:
    """Score of two nucleotides; null for other letters."""
    purine = lambda x: x.isin("A", "G")
    known = a.isin(*"ACGT") & b.isin(*"ACGT")
    return F.when(known, F.when(a == b, match).when(purine(a) == purine(b), transition).otherwise(transversion))
