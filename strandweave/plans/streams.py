"""Queries by SQL text with table functions, and by streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandweave.functions import tables
from strandweave.plans import registry as r
from strandweave.session import Scratch
from strandweave.streaming import sessions


def _sql(spark, df, text: str):
    """A query over one table, known to SQL by a name of its own while the query is resolved."""
    tables.register(spark)
    name = f"sw_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return spark.sql(text.format(table=name))
    finally:
        spark.catalog.dropTempView(name)


@r.query("sql_word_counts", "SELECT substr(text, i, 5) AS kmer, CAST(count(*) AS BIGINT) AS n FROM (SELECT text, unnest(range(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 5) GROUP BY 1")
def sql_word_counts(spark, d):
    """Word counts of all texts in SQL alone."""
    docs = r.spread(r.table(spark, d, "documents").select("text"))
    return _sql(spark, docs, "SELECT kmer, sum(n) AS n FROM sw_word_counts(TABLE(SELECT text FROM {table}), 5) GROUP BY kmer")


@r.query("sql_walk_arcs", r.ARCS)
def sql_walk_arcs(spark, d):
    """The arcs of each user's walk by a table function over an ordered partition."""
    events = r.table(spark, d, "events")
    return _sql(spark, events, "SELECT * FROM sw_walk(TABLE(SELECT user_id AS graph_id, event_type AS symbol, ts, event_id FROM {table}) PARTITION BY graph_id ORDER BY (ts, event_id))")


@r.query("streamed_sessions", """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOURS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s""")
def streamed_sessions(spark, d):
    """Sessions of users, six hours apart, by a stream that is stopped halfway and goes on from its checkpoint."""
    root = Scratch(spark, "sessions").root
    events = r.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    lots = 4
    lot = F.least(F.floor((F.col("at").cast("double") - low.timestamp()) / max((high - low).total_seconds(), 1) * lots), F.lit(lots - 1))
    for n in range(lots):
        events.where(lot == n).coalesce(1).write.mode("append").parquet(f"{root}/events")
        if n in (1, lots - 1):
            if n == lots - 1:
                sessions.closing(events, "user_id", "at", "6 hours", "1 day").write.mode("append").parquet(f"{root}/events")
            sessions.run(spark, f"{root}/events", f"{root}/sessions", f"{root}/state", "user_id", "at", "6 hours", "1 day")
    found = spark.read.schema("user_id long, start timestamp, last timestamp, n long").parquet(f"{root}/sessions")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")
