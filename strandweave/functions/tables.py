"""Table functions for SQL text: words of a text, counts of the words of many, and the arcs of a walk that SQL partitions and orders."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.operators import words

#: Letters whose words a task counts before it gives their counts out.
LOT = 1 << 22


class Words:
    """sw_words(text, k): (kmer, n) of the linear words of one text; nothing for a null or short one."""

    def eval(self, text: str, k: int):
        text = text or ""
        yield from Counter(text[i : i + k] for i in range(len(text) - k + 1)).items()


class WordCounts:
    """sw_word_counts(TABLE(...), k): (kmer, n) of the linear words of all texts that a task reads, in lots.

    The first column of the table is the text.  A word comes once for each lot
    that has it, so counts are to be summed; what is held is the texts of one lot.
    """

    def __init__(self):
        self.held, self.texts = 0, {}

    def eval(self, table: pa.RecordBatch, k: pa.Array) -> Iterator[pa.RecordBatch]:
        for text, size in zip(table.column(0), k):
            text, size = text.as_py() or "", size.as_py()
            if len(text) >= size:
                self.texts.setdefault(size, []).append(text)
                self.held += len(text)
            if self.held >= LOT:
                yield from self.terminate()

    def terminate(self) -> Iterator[pa.RecordBatch]:
        for k, texts in self.texts.items():
            yield pa.RecordBatch.from_arrays(list(words.counted(texts, k)), names=["kmer", "n"])
        self.held, self.texts = 0, {}


class Walk:
    """sw_walk(TABLE(...) PARTITION BY graph_id ORDER BY ...): (graph_id, u, v, m) of a circular walk.

    The table has the columns graph_id (whole numbers) and symbol (text).  What
    is held of a walk is its different arcs, not its steps.
    """

    def __init__(self):
        self.arcs: Counter = Counter()
        self.graph = self.first = self.last = None
        self.begun = False

    def eval(self, row):
        symbol = row["symbol"]
        if self.begun:
            self.arcs[self.last, symbol] += 1
        else:
            self.graph, self.first, self.begun = row["graph_id"], symbol, True
        self.last = symbol

    def terminate(self):
        if self.begun:
            self.arcs[self.last, self.first] += 1
        for (u, v), m in self.arcs.items():
            yield self.graph, u, v, m


def register(spark: SparkSession) -> None:
    """The table functions under their SQL names."""
    spark.udtf.register("sw_words", F.udtf(Words, returnType="kmer string, n bigint"))
    spark.udtf.register("sw_word_counts", F.arrow_udtf(WordCounts, returnType="kmer string, n bigint"))
    spark.udtf.register("sw_walk", F.udtf(Walk, returnType="graph_id bigint, u string, v string, m bigint"))
