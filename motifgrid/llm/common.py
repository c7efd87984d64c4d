"""Shared folders, written cut points and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A folder of `new_path`.
_WRITTEN = re.compile(r".*/[a-z-]+-[0-9a-f]{32}").fullmatch


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="motifgrid-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder with a bucket for each shuffle partition: joins on `key` don't shuffle it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", compression).format("parquet").saveAsTable(_table(path))
    return spark.table(_table(path))


def _table(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def removed(*frames: DataFrame) -> None:
    """Removes the folders (and tables) of frames that `written` and `bucketed` gave, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if _WRITTEN(folder):
                spark.sql(f"DROP TABLE IF EXISTS {_table(folder)}")
                path = hadoop.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about `most` bytes of `column` (a single row may be longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = lengths(batch.column(column))
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary column; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return held, at - at[0]


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(buffers(column)[1])


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)
