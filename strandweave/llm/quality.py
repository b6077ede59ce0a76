"""Document quality by histogram gradient-boosted trees (operator 3).

Each whole text becomes a row of statistics (shares of character kinds,
lengths of words and lines, repetition of neighbouring and distinct words) by
vectorised passes over the Arrow bytes.  Trees are grown level by level on
quantile histograms of these statistics with logistic loss and Newton leaves,
from labelled rows of the training folds only, at most ``most`` of them (a
documented bound, chosen by hash).  The ensemble is flattened into arrays
(feature, threshold, left child, value) and every batch is scored by walking
all of its documents down each tree together.

The model (some hundred kilobytes at most, fixed by ``trees`` and ``depth``)
goes to the executors with the function; nothing else is gathered.

Edge cases: a null or empty text has zero statistics and gets a score; with no
usable label, or labels of one kind only, the score is the (smoothed) share of
label 1; null labels are not used; rows that repeat a doc_id are scored each;
other columns, lang, source and doc_id among them, never reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import text as tx
from strandweave.llm.sampling import held_out, sample_of

MOST_ROWS, TREES, DEPTH, BINS, RATE = 20_000, 60, 4, 64, 0.15
THRESHOLD = 0.3
_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "mark", "symbol", "high")
FEATURES = (*_KINDS, "log_words", "word_mean", "word_sd", "lines_per_word", "upper_words", "marked_words", "lone_marks", "repeats", "distinct", "top_repeat")


def _kinds() -> np.ndarray:
    kind = np.full(256, _KINDS.index("symbol"), np.uint8)
    for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "newline": (10,), "stop": b".", "comma": b",;:", "mark": b"!?'\"()-", "high": range(128, 256)}.items():
        kind[list(chars)] = _KINDS.index(name)
    return kind


_KIND = _kinds()


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x FEATURES) statistics of whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _KIND[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[:, : len(_KINDS)] = np.bincount(doc * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1) / size[:, None]
    starts, lengths, counts = tx.words(data, offsets)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    some = np.maximum(counts, 1).astype(float)
    put = lambda name, values: out.__setitem__((slice(None), FEATURES.index(name)), values)
    put("lines_per_word", _sums(data == 10, offsets) / some)
    if not len(starts):
        return out
    mean = _sums(lengths, bounds) / some
    put("log_words", np.log1p(counts))
    put("word_mean", mean)
    put("word_sd", np.sqrt(np.maximum(_sums(lengths**2, bounds) / some - mean**2, 0)))
    final = kind[starts + lengths - 1]
    initial = kind[starts]
    marked = np.isin(final, [_KINDS.index("symbol"), _KINDS.index("mark")])
    second = kind[np.minimum(starts + 1, len(data) - 1)]
    put("upper_words", _sums((initial == 0) & (second == 0) & (lengths > 1), bounds) / some)
    put("marked_words", _sums(marked & (lengths > 1), bounds) / some)
    put("lone_marks", _sums(marked & (lengths == 1), bounds) / some)
    hashes = tx.word_hashes(data, starts, lengths)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][counts > 0]] = False
    put("repeats", _sums(same, bounds) / some)
    word_doc = np.repeat(np.arange(n), counts)
    order = np.lexsort((hashes, word_doc))
    h, d = hashes[order], word_doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    put("distinct", np.bincount(d[new], minlength=n) / some)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    put("top_repeat", top / some)
    return out


# ---------------------------------------------------------------- the trees


class Forest(NamedTuple):
    """Flattened trees: node t of every tree at position tree * nodes + t; a leaf has feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    trees: int
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        nodes = len(self.feature) // max(self.trees, 1)
        rows = np.arange(len(x))
        for t in range(self.trees):
            at = np.full(len(x), t * nodes)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0) -> Forest:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    feature = np.full(trees * nodes, -1)
    threshold, value, left = np.zeros(trees * nodes), np.zeros(trees * nodes), np.zeros(trees * nodes, np.int64)
    if not trees:
        return Forest(base, feature, threshold, left, value, 0, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            first, width = 2**level - 1, 2**level
            local = at - first
            here = local >= 0
            sg = np.bincount(local[here], g[here], width)
            sh = np.bincount(local[here], h[here], width)
            value[t * nodes + first : t * nodes + first + width] = -rate * sg / (sh + ridge)
            if level == depth:
                break
            gain, pick, cut = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                m = len(e) + 1
                code = local[here] * m + binned[here, j]
                gl = np.cumsum(np.bincount(code, g[here], width * m).reshape(width, m), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(code, h[here], width * m).reshape(width, m), axis=1)[:, :-1]
                score = gl**2 / (hl + ridge) + (sg[:, None] - gl) ** 2 / (sh[:, None] - hl + ridge) - (sg**2 / (sh + ridge))[:, None]
                score[(hl < 1) | (sh[:, None] - hl < 1)] = 0
                best = score.argmax(axis=1)
                better = score[np.arange(width), best] > gain
                gain[better], pick[better], cut[better] = score[np.arange(width), best][better], j, best[better]
            for k in np.flatnonzero(pick >= 0):
                i = t * nodes + first + k
                feature[i], threshold[i], left[i] = pick[k], edges[pick[k]][cut[k]], t * nodes + 2 * (first + k) + 1
            split = here & (pick[np.maximum(local, 0)] >= 0)
            rows = np.flatnonzero(split)
            k = local[rows]
            goes_right = binned[rows, pick[k]] > cut[k]
            nxt = np.full(len(y), -1, np.int64)
            nxt[rows] = 2 * at[rows] + 1 + goes_right
            done = here & ~split
            raw[done] += value[t * nodes + at[done]]
            at = np.where(split, nxt, -1)
        live = at >= 0
        raw[live] += value[t * nodes + at[live]]
    return Forest(base, feature, threshold, left, value, trees, depth)


# ---------------------------------------------------------------- Spark


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, stats) of the texts of a batch."""
    for batch in batches:
        for lo, hi, data, offsets in tx.slices(batch.column(1)):
            stats = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(FEATURES)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "stats"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, seed: int = 3, **options) -> Forest:
    """Fit on at most ``most`` labelled documents of the training folds."""
    labelled = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = sample_of(labelled, most, seed)
    # bounded: at most ``most`` ids and labels
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    stats = tx.map_texts(texts.select("doc_id", "text"), _stat_rows, "doc_id long, stats array<double>")
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("stats", "quality").toPandas()
    x = np.array(rows["stats"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float), **options)


def append_scores(docs: DataFrame, forest: Forest, column: str) -> DataFrame:
    """``docs`` with a column of scores; all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            scores = [forest.scores(statistics(d, o)) for _, _, d, o in tx.slices(texts)]
            kept = [i for i, n in enumerate(batch.schema.names) if i != batch.schema.get_field_index(column)]
            values = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), column])

    from pyspark.sql import types as T

    given = docs.withColumn(column, F.col("text").cast("string"))
    fields = [f for f in given.schema.fields if f.name != column]
    return tx.map_texts(given, run, T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    forest = train(docs, labels, most)
    scored = append_scores(docs.select("doc_id", "text"), forest, "_score")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
