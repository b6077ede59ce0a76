"""Language identification by sparse multinomial logistic regression (operator 10).

Features are hashed character n-grams (n = 1, 2, 3 of the lower-cased text,
white space collapsed to one kind) weighted by TF-IDF: share of the n-gram in
the text times its inverse document frequency, which is counted over all
documents of the training folds.  Weights are learned by FTRL-proximal with
elastic-net penalties, so most of them are exactly zero, from a sample of at
most ``most`` labelled documents (a documented bound, chosen by hash; a fifth
of it is set aside and calibrates the temperature of the softmax).

Scoring a text is one table lookup an n-gram: whole texts, in passages of a
few megabytes, never a prefix.  The frequency table has a fixed size (one
counter a bucket), summed over tasks in Spark before it reaches the driver.

Edge cases: a null text or one without a letter is ``und`` with score 0; where
no labelled document exists every text is ``und``; with one language all texts
with letters get it with score 1; rows that repeat a doc_id are predicted
each; other columns never reach a prediction.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import text as tx
from strandweave.llm.sampling import held_out, fold, sample_of

LOG = logging.getLogger(__name__)

BUCKET_BITS, GRAMS = 16, (1, 2, 3)
BUCKETS = 1 << BUCKET_BITS
MOST_DOCS, EPOCHS = 3_000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
#: Shares are small numbers; features are this many times larger.
SCALE = 20.0
#: Characters of one pass over a text.
PASSAGE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_U = np.uint32


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # buckets x languages, with idf folded in
    bias: np.ndarray
    temperature: float


def gram_ids(text: str) -> np.ndarray:
    """Bucket of every n-gram of a lower-cased passage."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), _U)
    codes = np.where(codes <= 32, _U(32), codes)
    parts = []
    for n in GRAMS:
        h = np.full(max(0, len(codes) - n + 1), n * 0x9E37, _U)
        for j in range(n):
            h = (h ^ codes[j : j + len(h)]) * _U(0x85EBCA6B)
            h ^= h >> _U(15)
        parts.append(h >> _U(32 - BUCKET_BITS))
    return np.concatenate(parts)


def passages(text: str) -> Iterator[np.ndarray]:
    """The buckets of a whole text, a passage at a time; each n-gram is counted once."""
    text, reach = text.lower(), max(GRAMS) - 1
    for lo in range(0, max(len(text), 1), PASSAGE):
        ids = gram_ids(text[lo : lo + PASSAGE + reach])
        if over := text[lo + PASSAGE : lo + PASSAGE + reach]:
            # the n-grams that begin in the overlap belong to the next passage
            left = np.bincount(ids, minlength=BUCKETS) - np.bincount(gram_ids(over), minlength=BUCKETS)
            ids = np.repeat(np.arange(BUCKETS), left)
        yield ids


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for ids in passages(text):
        total += np.bincount(ids, minlength=BUCKETS)
    return total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net for the multinomial loss; the last bucket row is the bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            error = softmax(x @ w)
            error[y[i]] -= 1
            g = x[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()
    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


# ---------------------------------------------------------------- Spark


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of every bucket among the texts of a task, and the number of texts (bucket -1)."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    flags = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            flags[:] = 0
            for ids in passages(text or ""):
                flags[ids] = 1
            total += flags
            n += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["bucket", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, grams): buckets and counts of a text as two runs of 32-bit integers."""
    for batch in batches:
        for row in batch.to_pylist():
            c = counts(row["text"] or "")
            at = np.flatnonzero(c)
            raw = at.astype(np.int32).tobytes() + c[at].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([row["lang"]]), pa.array([raw], pa.binary())], names=["doc_id", "lang", "grams"])


def train(docs: DataFrame, most: int = MOST_DOCS, seed: int = 10) -> Model:
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    rows = tx.map_texts(usable.select("text"), _frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy(np.int64)] = rows["df"].to_numpy(float)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # bounded: at most ``most`` ids travel, then the n-grams of as many texts
    chosen = sample_of(usable.select("doc_id", "lang").distinct(), most, seed)
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"])
    sample = tx.map_texts(texts, _sparse, "doc_id long, lang string, grams binary")
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "lang").limit(most).select("lang", "grams").toArrow()
    known = sample.column("lang").to_pylist()
    languages = sorted(set(known))
    y = np.array([languages.index(v) for v in known], np.int64)
    rows = []
    for cell in sample.column("grams"):
        at, c = np.frombuffer(cell.as_buffer(), np.int32).reshape(2, -1)
        x = c / max(c.sum(), 1) * idf[at] * SCALE
        rows.append((np.append(at, np.int32(BUCKETS)), np.append(x, 1.0).astype(np.float32)))
    del sample
    aside = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~aside)
    weights, bias = ftrl([rows[i] for i in learn], y[learn], len(languages))
    logits = np.array([x[:-1] @ weights[at[:-1]] + bias for at, x in (rows[i] for i in np.flatnonzero(aside))])
    if not aside.any():
        LOG.warning("language: %d labelled texts are too few to calibrate on some of them; the temperature is 1", len(rows))
    temperature = calibrated(logits, y[aside]) if aside.any() else 1.0
    return Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return langs, scores
    columns = [np.ascontiguousarray(model.weights[:, k]) for k in range(len(model.languages))]
    for i, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        z, n = np.zeros(len(columns)), 0
        for ids in passages(text):
            z += [float(np.take(c, ids).sum(dtype=np.float64)) for c in columns]
            n += len(ids)
        p = softmax((z / max(n, 1) + model.bias) / model.temperature)
        best = int(p.argmax())
        langs[i], scores[i] = model.languages[best], p[best]
    return langs, scores


def append_languages(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with a struct column (lang, score); all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            langs, scores = predict(model, batch.column(at).to_pylist())
            kept = [i for i in range(batch.num_columns) if i != at]
            made = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], names=[*(batch.schema.names[i] for i in kept), column])

    given = docs.withColumn(column, F.col("text").cast("string"))
    fields = [f for f in given.schema.fields if f.name != column]
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return tx.map_texts(given, run, T.StructType([*fields, T.StructField(column, kind)]))


def identify_languages(docs: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, most)
    named = append_languages(docs.select("doc_id", "text"), model, "_lang")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
