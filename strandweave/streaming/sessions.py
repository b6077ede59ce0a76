"""Sessions of event streams: state that expires, late rows that are counted, restarts from a checkpoint.

A session is a stretch of a key's events with no two neighbours more than ``gap``
apart.  A stream gives a session out once the watermark has passed its end and
forgets it then, so state holds open sessions only.  Rows behind the watermark
are dropped by Spark and counted here.  The same expression on a table gives
the sessions of a batch.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n): first and last time and number of events of each session."""
    found = events.groupBy(F.session_window(ts, gap), key).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return found.select(key, "start", "last", "n")


def closing(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """One row without a key, so far behind all events that a stream that reads it gives out every session."""
    far = F.max(ts) + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 second")
    made = events.agg(far.alias(ts)).where(F.col(ts).isNotNull()).withColumn(key, F.lit(None).cast(events.schema[key].dataType))
    return made.select(key, ts)


def run(spark: SparkSession, path: str, output: str, checkpoint: str, key: str, ts: str, gap: str, late: str, files_per_batch: int = 1) -> dict:
    """Takes the Parquet files below ``path`` that the checkpoint has not seen; appends closed sessions to ``output``.

    Returns the numbers of rows taken and of late rows dropped.
    """
    schema = spark.read.parquet(path).select(key, ts).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    closed = sessions(arriving.withWatermark(ts, late), key, ts, gap)
    stream = closed.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    seen = {"rows": 0, "late": 0}
    for p in stream.recentProgress:
        seen["rows"] += p.numInputRows
        seen["late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
    LOG.info("sessions: took %d rows from %s, %d of them late", seen["rows"], path, seen["late"])
    return seen
