"""Word spectra of pools of sequences, kept up to date as files of sequences arrive (incremental).

    python -m jobs.pool_spectra --config jobs/pool_spectra.json

A file stream over ``sequences`` (a folder, or a glob of files and folders, of
Parquet with doc_id, text, source) takes the
files its checkpoint has not seen yet.  The letters of a text make a circular
sequence over A, C, G, T; a pool is a source.  Each micro-batch is reduced to
(pool, word, occurrences, sequences that have the word) and written as one
partition of ``output``/deltas, named by the number of the batch: a batch that
is run again after a failure overwrites its own partition, so it counts once.

When no file is left, the deltas are added up and ``output``/spectrum is
written anew, partitioned by the first two letters of the word: how often a
word occurs in a pool, in how many sequences, and whether it is a core word,
one that every sequence of the pool (of k letters or more) has.

Deltas hold at most 4**k words a pool and batch, whatever the size of a file;
texts are read once, deltas at every run.  A run without new files writes the
same spectrum again.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import main
from strandweave.functions import sequences as fs
from strandweave.operators import words

LOG = logging.getLogger("pool_spectra")

INPUT = "doc_id long, text string, source string"
DELTA = "pool string, kmer string, n long, sequences long, batch long"
SPECTRUM = "pool string, kmer string, n long, sequences long, core boolean, prefix string"


def delta(docs: DataFrame, k: int) -> DataFrame:
    """(pool, kmer, n, sequences) of some documents, read once; the empty word counts the sequences of a pool."""
    seqs = docs.select(F.col("source").alias("pool"), fs.pseudo_dna("text").alias("seq"))
    return words.word_counts(seqs, k, circular=True, keys=("pool",), holders=True)


def spectrum(deltas: DataFrame) -> DataFrame:
    """(pool, kmer, n, sequences, core, prefix) of all deltas."""
    total = deltas.groupBy("pool", "kmer").agg(F.sum("n").alias("n"), F.sum("sequences").alias("sequences"))
    pools = total.where("kmer = ''").select(F.col("pool").alias("_pool"), F.col("sequences").alias("_all"))
    found = total.where("kmer <> ''")
    found = found.join(pools, F.col("pool").eqNullSafe(F.col("_pool")))
    return found.select("pool", "kmer", "n", "sequences", (F.col("sequences") == F.col("_all")).alias("core"), F.substring("kmer", 1, 2).alias("prefix"))


def run(spark: SparkSession, sequences: str, output: str, checkpoint: str, k: int = 6, files_per_batch: int = 64) -> None:
    if not 2 <= k <= 12:
        raise ValueError("k must be from 2 to 12: a spectrum has up to 4**k words a pool")

    def put(docs: DataFrame, batch: int) -> None:
        out = delta(docs, k).withColumn("batch", F.lit(batch))
        out.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{output}/deltas")

    # an empty append makes the folder, so that there is something to add up before the first file comes
    spark.createDataFrame([], DELTA).write.partitionBy("batch").mode("append").parquet(f"{output}/deltas")
    arriving = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(sequences)
    stream = arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    taken = [p.numInputRows for p in stream.recentProgress]
    LOG.info("read %d new rows in %d batches from %s", sum(taken), sum(n > 0 for n in taken), sequences)

    spectrum(spark.read.schema(DELTA).parquet(f"{output}/deltas")).write.partitionBy("prefix").mode("overwrite").parquet(f"{output}/spectrum")
    written = read(spark, output).agg(F.count("*"), F.count_distinct("pool"), F.count_if("core")).first()
    LOG.info("wrote %d words of %d pools, %d of them core words, to %s/spectrum", *written, output)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SPECTRUM).parquet(f"{output}/spectrum")


if __name__ == "__main__":
    main("pool_spectra", __doc__, run, {"sequences": str, "output": str, "checkpoint": str, "k": int, "files_per_batch": int})
