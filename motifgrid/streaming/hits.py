"""Evaluation of hits as search jobs append them, and windowed letter counts of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import first_false_positive

HITS = "query string, target string, prod double, lddt double, score double, rank int"


def hit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Hits from space-separated files that appear in a folder; a file holds whole queries."""
    return spark.readStream.schema(HITS).option("sep", " ").csv(path)


def evaluate_stream(hits: DataFrame, classes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that evaluates each batch of whole queries against the class table and hands it to sink."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(first_false_positive(rows.select("query", "target", "rank"), classes), number)

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def letter_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, letter, n of a stream of (ts, event_type); what comes later than `late` is dropped by the watermark."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("letter")).agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("start"), "letter", "n")
