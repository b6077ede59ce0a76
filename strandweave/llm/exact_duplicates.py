"""Exact duplicates by content sort (operator 11).

Texts are equal when they are identical after lower-casing A-Z.  The
normalised bytes are sorted over the whole cluster: Spark samples splitters,
deals the rows out by range and sorts every range externally.  In a sorted
range equal texts are neighbours, so one pass that compares each text in full
with the one before it numbers the runs of equal texts.  Where two ranges
meet, the last text of one is compared with the first of the next, and prefix
sums over the ranges turn local run numbers into classes.

Rows are ordered by the first ``HEAD`` bytes, a hash of the whole text, the
whole text, and the identifier.  The first two and the identifier make the
splitters, so a splitter is small whatever the length of a text, and the
copies of one text are split over as many ranges as they need.  The hash only
orders: rows are equal because their whole texts are.

Every range is read once as a stream; what is written is small (identifiers,
one row a run, two texts a range).  Rows meet the size and the survivor of
their class by (range, run), so no key holds more rows than a range.

Edge cases: a null text is an empty one; a null identifier stays only where
its class has no other; of several rows with the identifier that stays, one is
kept; long texts are compared whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm import text as tx
from strandweave.session import Scratch

#: Bytes of a text that a splitter holds.
HEAD = 64
_KEYS = "doc_id long, head binary, hash long, norm binary"
#: kind 0: a row; 1: a run; 2 and 3: the first and the last text of a range.
_RUNS = "kind int, part int, run long, doc_id long, first boolean, n long, keep long, sha string, norm binary"
ROW, RUN, FIRST, LAST = range(4)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised bytes with what orders them."""
    for batch in batches:
        for lo, hi, data, offsets in tx.slices(batch.column(1)):
            norm = tx.LOWER[data]
            raw = norm.tobytes()
            cuts = offsets.tolist()
            texts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            hashes = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts), np.int64)
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)])
            columns = [batch.column(0).slice(lo, hi - lo), pa.array([t[:HEAD] for t in texts], pa.binary()), pa.array(hashes), whole.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "head", "hash", "norm"])


class _Out:
    """Rows of ``_RUNS``, column by column."""

    def __init__(self, part: int):
        self.part, self.rows = part, []

    def add(self, kind: int, run: int, doc_id=None, first=None, n=None, keep=None, sha=None, norm=None) -> None:
        self.rows.append((kind, self.part, run, doc_id, first, n, keep, sha, norm))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _RUNS.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal texts of one sorted range; of a run, the first row has the identifier that stays."""
    out, run, last, last_hash = _Out(TaskContext.get().partitionId()), -1, None, None
    n, keep = 0, None
    for batch in batches:
        ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        texts = batch.column(3)
        for i, (doc_id, hashed) in enumerate(zip(ids, hashes)):
            text = None
            if hashed == last_hash:
                text = texts[i].as_py()
            new = text is None or text != last
            if new:
                text = texts[i].as_py() if text is None else text
                if last is None:
                    out.add(FIRST, 0, norm=text)
                else:
                    out.add(RUN, run, n=n, keep=keep, sha=hashlib.sha256(last).hexdigest())
                run, n, keep, last, last_hash = run + 1, 0, doc_id, text, hashed
            n += 1
            out.add(ROW, run, doc_id=doc_id, first=new)
        if out.rows:
            yield out.batch()
    if last is not None:
        out.add(RUN, run, n=n, keep=keep, sha=hashlib.sha256(last).hexdigest())
        out.add(LAST, run, norm=last)
        yield out.batch()


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """Per row: doc_id, keep_id (the row that stays of its class), group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest identifier of a class stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-duplicates")
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    keyed = tx.map_texts(given, _keyed, _KEYS).repartitionByRange("head", "hash", order)
    found = scratch.save(tx.map_texts(keyed.sortWithinPartitions("head", "hash", "norm", order), _runs, _RUNS), "runs")

    # one row a range: is its first run the last one of the range before it?
    spans = found.where(F.col("kind") == LAST).select("part", (F.col("run") + 1).alias("runs")).withColumn("before", F.lag("part").over(Window.orderBy("part")))
    firsts = found.where(F.col("kind") == FIRST).select("part", F.col("norm").alias("head"))
    lasts = found.where(F.col("kind") == LAST).select(F.col("part").alias("before"), F.col("norm").alias("tail"))
    spans = spans.join(firsts, "part").join(lasts, "before", "left").select("part", "runs", F.coalesce(F.col("head") == F.col("tail"), F.lit(False)).alias("joined"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = scratch.save(spans.select("part", "joined", (F.sum("runs").over(upto) - F.col("runs") - F.sum(F.col("joined").cast("long")).over(upto)).alias("base")), "spans")
    # the table has a row for each task of the sort
    spans = F.broadcast(spans)

    runs = found.where(F.col("kind") == RUN).join(spans, "part").select("part", "run", (F.col("base") + F.col("run")).alias("class"), "n", "keep", "sha")
    best = F.max("keep") if keep == "largest" else F.min("keep")
    classes = runs.groupBy("class").agg(F.sum("n").alias("group_size"), best.alias("keep_id"))
    runs = runs.select("part", "run", "class", "sha").join(classes, "class").drop("class")
    rows = found.where(F.col("kind") == ROW).select("part", "run", "doc_id", "first").join(spans.select("part", "joined"), "part")
    kept = F.col("first") & ~((F.col("run") == 0) & F.col("joined"))
    return rows.join(runs, ["part", "run"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


EXACT_DUPLICATE_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
