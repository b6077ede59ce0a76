"""Incremental word counts with Structured Streaming.

Batches of sequences arrive as files; word counts are kept by an aggregation
in update mode, and a windowed variant counts words of event time windows and
drops what comes later than its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.words import occurrences


def stream_sequences(spark: SparkSession, path: str, schema: str = "seq_id long, seq string", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_spectrum(seqs: DataFrame, k: int, circular: bool = False) -> DataFrame:
    """(kmer, n) over everything seen so far; write it in update or complete mode."""
    return occurrences(seqs, k, circular).groupBy("kmer").agg(F.count("*").alias("n"))


def windowed_walk_arcs(events: DataFrame, ts: str, symbol: str, width: str, late: str) -> DataFrame:
    """(start, symbol, n): symbols of tumbling event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), symbol).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), symbol, "n")
