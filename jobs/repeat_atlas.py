"""Repeat graphs of sequences at several word lengths (batch).

    python -m jobs.repeat_atlas --config jobs/repeat_atlas.json

The letters of a text make a circular sequence over A, C, G, T.  For each word
length k the words that occur more than once in a sequence are the vertices of
its compacted repeat graph, and the stretches from one such occurrence to the
next its arcs.  The job writes, for each k, one row a sequence
(``output``/sequences/k=...) with the size of that graph, its heaviest word,
its longest stretch and whether every vertex is a branch, and totals by pool
(``output``/pools/k=...).

Each k has a folder of its own, which a rerun overwrites: the same input gives
the same result, and a run with another k leaves the others as they are.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import main
from strandweave.functions import sequences as fs
from strandweave.operators import words

LOG = logging.getLogger("repeat_atlas")

INPUT = "doc_id long, text string, source string"
ATLAS = "seq_id long, pool string, letters long, vertices long, arcs long, occurrences long, most long, branches long, longest long, k int"
POOLS = "pool string, sequences long, repetitive long, letters long, vertices long, occurrences long, longest long, k int"


def atlas(seqs: DataFrame, k: int) -> DataFrame:
    """One row for each of (seq_id, pool, seq); sequences without a repeated word have an empty graph."""
    graphs = words.arc_summary(seqs, k)
    whole = seqs.select("seq_id", "pool", F.length("seq").cast("long").alias("letters"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("vertices", "arcs", "occurrences", "most", "branches", "longest")]
    return whole.join(graphs, "seq_id", "left").select("seq_id", "pool", "letters", *numbers)


def by_pool(rows: DataFrame) -> DataFrame:
    total = [F.sum(c).alias(c) for c in ("letters", "vertices", "occurrences")]
    return rows.groupBy("pool").agg(F.count("*").alias("sequences"), F.count_if(F.col("vertices") > 0).alias("repetitive"), *total, F.max("longest").alias("longest"))


def run(spark: SparkSession, sequences: str, output: str, widths: list[int] | tuple[int, ...] = (12, 16, 24)) -> None:
    docs = spark.read.schema(INPUT).parquet(sequences)
    seqs = docs.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("pool"), fs.pseudo_dna("text").alias("seq"))
    LOG.info("read %d rows from %s", docs.count(), sequences)
    for k in widths:
        atlas(seqs, k).write.mode("overwrite").parquet(f"{output}/sequences/k={k}")
        rows = spark.read.parquet(f"{output}/sequences/k={k}")
        by_pool(rows).write.mode("overwrite").parquet(f"{output}/pools/k={k}")
        LOG.info("k=%d: wrote %d sequences, %d of them with repeats, to %s", k, rows.count(), rows.where("vertices > 0").count(), output)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ATLAS).parquet(f"{output}/sequences")


def read_pools(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(POOLS).parquet(f"{output}/pools")


if __name__ == "__main__":
    main("repeat_atlas", __doc__, run, {"sequences": str, "output": str, "widths": lambda s: [int(x) for x in s.split(",")]})
