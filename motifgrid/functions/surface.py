"""Functions that SQL text can call: Arrow scalars, and table functions for LATERAL joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def _row(**fields: type) -> StructType:
    """A row type, as text would need a session."""
    return StructType([StructField(k, IntegerType() if t is int else StringType()) for k, t in fields.items()])


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted Jaccard of two vectors of one length; null where one is null, lengths differ, a component is null, or all are zero."""

    def one(x, y):
        if x is None or y is None or len(x) != len(y):
            return None
        x, y = np.asarray(x, float), np.asarray(y, float)
        high = np.maximum(x, y).sum()
        return float(np.minimum(x, y).sum() / high) if high > 0 else None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def bitscore(score: pd.Series, lam: pd.Series, k: pd.Series) -> pd.Series:
    """(lam * score - ln k) / ln 2."""
    return (lam * score - np.log(k)) / np.log(2)


@F.udtf(returnType=_row(op=int, kind=str, len=int, first1=int, first2=int))
class ParseCigar:
    """The operations of a CIGAR text, and the first residue of both sequences in each, from 1-based starts."""

    def eval(self, cigar: str, start1: int, start2: int) -> Iterator[tuple]:
        i, j = start1 - 1, start2 - 1
        for n, (size, kind) in enumerate(re.findall(r"(\d+)([A-Za-z])", cigar or "")):
            yield n, kind, int(size), i, j
            i += int(size) if kind != "D" else 0
            j += int(size) if kind != "I" else 0


@F.udtf(returnType=_row(col=int, i=int, j=int))
class ExpandAlignment:
    """The columns of an alignment array (partner of each residue, -1 for none): a jump opens a gap in the first, unless a gap precedes it."""

    def eval(self, aln: list[int]) -> Iterator[tuple]:
        col, before = 0, -1
        for i, j in enumerate(aln if aln is not None else []):
            for skipped in range(before + 1, j) if before >= 0 else ():
                yield col, None, skipped
                col += 1
            yield col, i, j if j >= 0 else None
            col, before = col + 1, j


def register(spark: SparkSession) -> None:
    """Names for SQL: jaccard(a, b), bitscore(score, lam, k), parse_cigar(cigar, start1, start2), expand_alignment(aln)."""
    spark.udf.register("jaccard", jaccard)
    spark.udf.register("bitscore", bitscore)
    spark.udtf.register("parse_cigar", ParseCigar)
    spark.udtf.register("expand_alignment", ExpandAlignment)
