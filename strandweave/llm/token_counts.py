"""Token-count totals maintained by signed deltas (operator 4).

Changes to documents arrive in batches.  An insert adds (+1 document, +tokens)
to its cell (source, language, tokenizer version), a delete subtracts the same,
and a revised count adds the difference.  A batch is reduced to one row per
touched cell, written to a folder of its own, and then published: version n+1
of a small manifest names the folders of version n and the new one, and the
batches applied so far.  Publishing creates a file that must not exist yet, in
one atomic step; of two writers one wins, and the other looks again at what
has been applied.  So a batch counts once, however often it is sent, and a
crash between any two steps leaves the last published version as it was.

``compact`` publishes a version that names one folder of totals instead of
many.  Nothing a reader may still use is removed; ``vacuum`` deletes what the
newest version does not name.

The sums are additive, so a hot source or language is reduced in every task
before the shuffle and no row of the corpus is read again for a new batch.

Edge cases: null source, language or tokenizer version are cells of their own;
a null count is 0; an empty batch is applied and has no cells; a cell whose
documents and tokens have returned to 0 is left out of the totals; rows that
repeat are counted as often as they come; a null or empty text has no tokens;
texts of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import text as tx
from strandweave.session import Scratch, shared_dir

CELL = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    return _change(counts, F.lit(1), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return _change(counts, F.lit(-1), -F.col("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changed counts: ``tokens`` is the new one, ``old_tokens`` what was counted before."""
    return _change(counts, F.lit(0), F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0)))


def _change(counts: DataFrame, docs, tokens) -> DataFrame:
    return counts.select(*CELL, docs.cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


class TokenRollup:
    """Totals by source, language and tokenizer version below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)
        for name in ("parts", "versions", "staged"):
            self.fs.mkdirs(self._at(name))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))]

    def _latest(self) -> tuple[int, dict]:
        """Number and manifest of the newest version (0 and an empty one before the first)."""
        number = max((int(n) for n in self._names("versions") if n.isdigit()), default=0)
        if not number:
            return 0, {"parts": [], "batches": []}
        stream = self.fs.open(self._at(f"versions/{number:020d}"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> bool:
        """Make ``manifest`` version ``number``; False where another writer has done so."""
        staged, target = self._at(f"staged/{uuid.uuid4().hex}"), self._at(f"versions/{number:020d}")
        out = self.fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # where a rename replaces the target
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context.rename(staged, target, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError:
            if not self.fs.exists(target):
                raise
            return False
        finally:
            self.fs.delete(staged, False)

    def _write(self, delta: DataFrame) -> str:
        name = uuid.uuid4().hex
        delta.write.parquet(f"{self.path}/parts/{name}")
        return name

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], DELTA)
        return _summed(self.spark.read.schema(DELTA).parquet(*[f"{self.path}/parts/{p}" for p in parts]))

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._latest()[1]["batches"]

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False where it had been committed already."""
        part = None
        while True:
            number, now = self._latest()
            if batch_id in now["batches"]:
                return False
            part = part or self._write(_summed(changes.select(*CELL, "docs", "tokens")))
            if self._publish(number + 1, {"parts": [*now["parts"], part], "batches": [*now["batches"], batch_id]}):
                return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of every cell that holds something."""
        return self._read(self._latest()[1]["parts"])

    def compact(self) -> None:
        """Name one folder of totals instead of the many that were summed."""
        number, now = self._latest()
        if len(now["parts"]) < 2:
            return
        merged, old = self._write(self._read(now["parts"])), set(now["parts"])
        while not self._publish(number + 1, {"parts": [merged, *(p for p in now["parts"] if p not in old)], "batches": now["batches"]}):
            number, now = self._latest()
            if not old <= set(now["parts"]):  # another compaction was faster
                return

    def vacuum(self) -> None:
        """Delete folders and versions that the newest one does not need; no writer or older reader may be at work."""
        number, now = self._latest()
        for folder, kept in (("parts", {*now["parts"]}), ("versions", {f"{number:020d}"}), ("staged", set())):
            for name in self._names(folder):
                if name not in kept:
                    self.fs.delete(self._at(f"{folder}/{name}"), True)


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*CELL).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def tokenizer_counts(docs: DataFrame, tokenizer: str, version: str, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, source, lang, tokenizer (the given version name), tokens by a public tokenizer's file."""
    from strandweave.llm.tokens import WordEncoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder(tokenizer, True)
        for batch in batches:
            texts = [x or "" for x in batch.column(3).to_pylist()]
            n = pa.array(np.array([len(ids) // 4 for ids in coder.encode(texts)], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([version] * len(n), pa.string()), n], names=[id_column, "source", "lang", "tokenizer", "tokens"])

    given = docs.select(id_column, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return tx.map_texts(given, run, f"`{id_column}` {kind}, source string, lang string, tokenizer string, tokens long")


def document_counts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, lang, words (split at white space), letters (runs of letters)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), number(r"[^\x20\x09-\x0D]+").alias("words"), number(r"\p{L}+").alias("letters"))


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over ``documents``, two of them sent twice.

    All documents are counted under tokenizer versions ``words`` and
    ``letters``; documents labelled toxic are taken down; the word counts of
    documents labelled as of low quality are revised to their letter runs.
    """
    scratch = Scratch(spark, "token-counts")
    counts = scratch.save(document_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    by_words = counts.select("doc_id", "source", "lang", F.lit("words").alias("tokenizer"), F.col("words").alias("tokens"))
    by_letters = counts.select("doc_id", "source", "lang", F.lit("letters").alias("tokenizer"), F.col("letters").alias("tokens"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct()
    gone = deletes(by_words.join(toxic, "doc_id", "left_semi")).unionByName(deletes(by_letters.join(toxic, "doc_id", "left_semi")))
    revised = counts.join(poor, "doc_id", "left_semi").join(toxic, "doc_id", "left_anti").select("source", "lang", F.lit("words").alias("tokenizer"), F.col("letters").alias("tokens"), F.col("words").alias("old_tokens"))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    batches = [("words", inserts(by_words)), ("letters", inserts(by_letters)), ("takedown", gone), ("recount", revisions(revised))]
    for batch_id, changes in [*batches, batches[2], batches[0]]:
        rollup.apply(batch_id, changes)
    rollup.compact()
    rollup.vacuum()
    return rollup.totals()


TOKEN_COUNT_SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS letters FROM documents),
t AS (
  SELECT c.*, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS poor FROM c),
u AS (
  SELECT source, lang, 'words' AS tokenizer, CASE WHEN poor THEN letters ELSE words END AS n FROM t WHERE NOT toxic
  UNION ALL SELECT source, lang, 'letters', letters FROM t WHERE NOT toxic)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM u GROUP BY 1, 2, 3
"""
