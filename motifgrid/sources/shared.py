"""Tables written to the shared folder: cuts of the lineage that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of the one that spark.checkpoint.dir names; of a temporary one only where that is unset, on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="motifgrid-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/motifgrid-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Removes the folders of frames that `written` gave, once nothing reads them any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("motifgrid-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
