"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Documents are counted into cells (source, language, topic) of tokens.  The
cell weights are raked: each pass scales them to the target marginal of
source, then of language, then of topic, until all three hold.  The targets
sum to a chosen fraction of the tokens, and no cell's weight passes its tokens,
so a cell's weight over its tokens is the probability with which its documents
are kept, and the expected sample itself has the target marginals.  A value
with fewer tokens than its target is kept whole, and the other values of its
dimension share the rest.  The draw is a hash of the document's id, so it can
be repeated.

Only cell totals are gathered: up to ``MOST_CELLS`` of them are raked on the
driver (the number is checked first), more as a DataFrame, one aggregation a
marginal and pass, in the shared folder.

A topic is the vocabulary group (of ``topics`` groups, by the hash of a
lower-cased word) to which most words of eight or more bytes of the whole
text belong, ties to the smaller number; tokens are words split at white space.

Edge cases: nulls in source or lang are a value of their own; a null or empty
text has no tokens, topic 0 and is kept with probability 1 (it weighs
nothing); a null doc_id draws one common number; repeated rows share their
draw; an empty table gives no rows.  Texts of any length are counted whole.
Other columns pass through, whatever their names; one named as the result
column is replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import text as tx
from strandweave.session import Scratch

TOPICS, LONG_WORD = 8, 8
MOST_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its observed share of tokens to this power (1 leaves it, 0 makes all equal).
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.0}
FRACTION = 0.7
#: Raking ends when a pass finds every marginal within CLOSE of its target, or after so many passes.
PASSES, CLOSE = 500, 1e-10
#: Marginals that cannot hold together drive weights to 0 or beyond all bounds; they stay within LEAST and 1 / LEAST.
LEAST = 1e-100
#: A marginal further from its target than this is reported, of each dimension so many, the worst first.
UNMET, SHOWN = 1e-6, 20
LOG = logging.getLogger(__name__)
_MADE = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("topic", T.LongType())])


def count_and_topic(data: np.ndarray, offsets: np.ndarray, topics: int) -> tuple[np.ndarray, np.ndarray]:
    starts, lengths, counts = tx.words(data, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    far = lengths >= LONG_WORD
    groups = (tx.word_hashes(data, starts[far], lengths[far]) % np.uint64(topics)).astype(np.int64)
    votes = np.bincount(doc[far] * topics + groups, minlength=len(counts) * topics).reshape(len(counts), topics)
    return counts, votes.argmax(axis=1)


def with_topics(docs: DataFrame, column: str, topics: int = TOPICS) -> DataFrame:
    """``docs`` with a struct column (tokens, topic); all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = [count_and_topic(d, o, topics) for _, _, d, o in tx.slices(batch.column(at))]
            columns = [pa.array(np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64), pa.int64()) for i in (0, 1)]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.StructArray.from_arrays(columns, ["tokens", "topic"])], names=[*(batch.schema.names[i] for i in kept), column])

    given = docs.withColumn(column, F.col("text").cast("string"))
    fields = [f for f in given.schema.fields if f.name != column]
    return tx.map_texts(given, run, T.StructType([*fields, T.StructField(column, _MADE)]))


# ---------------------------------------------------------------- raking


def rake(codes: list[np.ndarray], weights: np.ndarray, targets: list[np.ndarray], passes: int = PASSES, close: float = CLOSE, most: np.ndarray | None = None) -> np.ndarray:
    """Weights whose sums over each coding equal its targets (all targets have one total), none above ``most``.

    A factor is kept beyond the bound, so a weight is min(most, start * product
    of factors).  The sum of a value is then concave in its factor; a pass
    makes one Newton step for each value.
    """
    w = weights.astype(float).copy()
    most = np.full(len(w), np.inf) if most is None else most
    for _ in range(passes):
        off = 0.0
        for code, target in zip(codes, targets):
            shut = np.bincount(code, np.where(w < most, 0.0, most), len(target))
            free = np.bincount(code, np.where(w < most, w, 0.0), len(target))
            have = shut + free
            newton = (target > shut) & (free > 0)
            factor = np.where(have > 0, target / np.maximum(have, 1e-300), 0.0)
            factor = np.where(newton, (target - shut) / np.maximum(free, 1e-300), factor)
            factor[(free == 0) & (target >= shut) & (have > 0)] = 1.0
            off = max(off, float((np.abs(have - target) / np.where(target > 0, target, 1))[have > 0].max(initial=0)))
            w *= factor[code]
            w = np.where(w > 0, np.clip(w, LEAST, 1 / LEAST), 0.0)
        if off < close:
            break
    return np.minimum(w, most)


def reachable(shares: np.ndarray, held: np.ndarray, total: float) -> np.ndarray:
    """Targets in the ratio of ``shares`` that sum to ``total``; a value that holds less gives all it has, the others the rest."""
    factor = total / max(shares.sum(), 1e-300)
    while True:
        shut = factor * shares >= held
        left, free = total - held[shut].sum(), shares[~shut].sum()
        if free <= 0 or left <= factor * free * (1 + 1e-14):
            return np.minimum(factor * shares, held)
        factor = left / free


def tempered(code: np.ndarray, weights: np.ndarray, power: float) -> np.ndarray:
    have = np.bincount(code, weights)
    shares = np.where(have > 0, have / max(have.sum(), 1e-300), 0) ** power * (have > 0)
    return shares / max(shares.sum(), 1e-300) * weights.sum()


def probabilities(tokens: np.ndarray, raked: np.ndarray, fraction: float) -> np.ndarray:
    """Capped probabilities in the ratio raked / tokens that keep ``fraction`` of the tokens in expectation."""
    ratio = raked / np.maximum(tokens, 1e-300)
    lo, hi = 0.0, 1.0
    while (np.minimum(1, hi * ratio) * tokens).sum() < fraction * tokens.sum() and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(1, mid * ratio) * tokens).sum() < fraction * tokens.sum() else (lo, mid)
    return np.minimum(1, hi * ratio)


def cell_probabilities(cells: DataFrame, temper: dict[str, float], fraction: float, most: int = MOST_CELLS, targets: dict[str, dict] | None = None) -> DataFrame:
    """(source, lang, topic, probability) of every cell with tokens."""
    spark = cells.sparkSession
    kinds = "source string, lang string, topic long, probability double"
    targets = targets or {}
    if cells.count() <= most:
        rows = cells.toPandas()
        if not len(rows):
            return spark.createDataFrame([], kinds)
        tokens = rows["tokens"].to_numpy(float)
        codes = [rows[d].map(repr).astype("category").cat.codes.to_numpy(np.int64) for d in DIMENSIONS]
        held = [np.bincount(c, tokens) for c in codes]
        shares = []
        for c, d in zip(codes, DIMENSIONS):
            values = {int(k): None if v is None or v != v else v for k, v in zip(c, rows[d])}
            shares.append(tempered(c, tokens, temper[d]) if d not in targets else np.array([float(targets[d].get(values[k], 0)) for k in range(len(values))]))
        # values of share 0 and those that run out can leave less than the fraction
        total = min(np.minimum(np.where(s > 0, h, 0), h).sum() for s, h in zip(shares, held))
        total = min(total, fraction * tokens.sum())
        raked = rake(codes, tokens * fraction, [reachable(s, h, total) for s, h in zip(shares, held)], most=tokens)
        fraction = total / tokens.sum()
        rows = rows[list(DIMENSIONS)].assign(probability=probabilities(tokens, raked, fraction))
        for c, d, s in zip(codes, DIMENSIONS, shares):
            want, have = s / max(s.sum(), 1e-300) * total, np.bincount(c, rows["probability"] * tokens)
            far = [k for k in np.argsort(-np.abs(have - want), kind="stable") if abs(have[k] - want[k]) > UNMET * max(want[k], 1)][:SHOWN]
            _report(d, [(rows[d].iloc[int(np.argmax(c == k))], want[k], have[k]) for k in far], total)
        # checked above: at most ``most`` rows
        return F.broadcast(spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in rows.itertuples(index=False)], kinds))
    return _rake_table(cells, temper, fraction, targets).select(*DIMENSIONS, "probability")


def _report(dimension: str, unmet: list[tuple], total: float) -> None:
    """A warning for each marginal of the expected sample that is not its target."""
    for value, want, have in unmet:
        LOG.warning("mixing: %s %r has the share %.6f of the sample, its target is %.6f", dimension, value, have / max(total, 1e-300), want / max(total, 1e-300))


def _rake_table(cells: DataFrame, temper: dict[str, float], fraction: float, targets: dict[str, dict], passes: int = PASSES, close: float = CLOSE) -> DataFrame:
    """The same for more cells than the driver should hold: every marginal is an aggregation and a join."""
    scratch = Scratch(cells.sparkSession, "raking")
    total = cells.agg(F.sum("tokens")).first()[0]
    shares = {}
    for d in DIMENSIONS:
        t = cells.groupBy(F.col(d).alias("v")).agg(F.sum("tokens").alias("held"))
        if d in targets:
            given = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in targets[d].items()], T.StructType([T.StructField("g", cells.schema[d].dataType), T.StructField("share", T.DoubleType())]))
            t = t.join(given, F.col("v").eqNullSafe(F.col("g")), "left").select("v", "held", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            t = t.withColumn("share", (F.col("held") / total) ** F.lit(temper[d]))
        shares[d] = scratch.save(t, f"share-{d}")
    kept = min([fraction * total, *(t.where("share > 0").agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0] for t in shares.values())])
    wanted = {}
    for d, t in shares.items():  # as in ``reachable``
        factor = kept / max(t.agg(F.sum("share")).first()[0], 1e-300)
        while True:
            shut = F.lit(factor) * F.col("share") >= F.col("held")
            left, free = t.agg(kept - F.coalesce(F.sum(F.when(shut, F.col("held"))), F.lit(0)), F.coalesce(F.sum(F.when(~shut, F.col("share"))), F.lit(0.0))).first()
            if free <= 0 or left <= factor * free * (1 + 1e-14):
                break
            factor = left / free
        wanted[d] = scratch.save(t.select("v", F.least(F.lit(factor) * F.col("share"), F.col("held")).alias("target")), f"target-{d}")
    table = scratch.save(cells.withColumn("w", F.lit(fraction) * F.col("tokens")), "0")
    target, tight, loose = F.col("target"), F.col("tight"), F.col("loose")
    miss = F.when(tight + loose > 0, F.abs(tight + loose - target) / F.when(target > 0, target).otherwise(1.0)).otherwise(0.0)
    for step in range(1, passes + 1):
        table = table.withColumn("off", F.lit(0.0))
        for d in DIMENSIONS:
            full = F.col("w") >= F.col("tokens")
            have = table.groupBy(F.col(d).alias("u")).agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("tight"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("loose"))
            f = F.when(tight + loose <= 0, 0.0).when((loose <= 0) & (target >= tight), 1.0).when((target > tight) & (loose > 0), (target - tight) / loose).otherwise(target / (tight + loose))
            factor = have.join(wanted[d], F.col("u").eqNullSafe(F.col("v"))).select("u", f.alias("f"), miss.alias("miss"))
            table = table.join(factor, F.col(d).eqNullSafe(F.col("u"))).withColumn("w", F.col("w") * F.col("f")).withColumn("w", F.when(F.col("w") > 0, F.least(F.greatest("w", F.lit(LEAST)), F.lit(1 / LEAST))).otherwise(0.0)).withColumn("off", F.greatest("off", "miss")).drop("u", "f", "miss")
        table = scratch.save(table, str(step))
        scratch.drop(str(step - 1))
        if table.agg(F.max("off")).first()[0] < close:
            break
    lo, hi = 0.0, 1.0
    sample = lambda x: table.agg(F.sum(F.least(F.lit(1.0), F.lit(x) * F.least("w", "tokens") / F.col("tokens")) * F.col("tokens"))).first()[0]
    while sample(hi) < kept and hi < 1e12:
        hi *= 2
    for _ in range(100):
        if hi - lo < 1e-15 * hi:
            break
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sample(mid) < kept else (lo, mid)
    table = table.withColumn("probability", F.least(F.lit(1.0), F.lit(hi) * F.least("w", "tokens") / F.col("tokens"))).drop("off")
    for d, t in shares.items():
        whole = t.agg(F.sum("share")).first()[0] or 1.0
        own = table.groupBy(F.col(d).alias("u")).agg(F.sum(F.col("probability") * F.col("tokens")).alias("have"))
        want = F.col("share") / whole * kept
        own = own.join(t, F.col("u").eqNullSafe(F.col("v"))).select("v", want.alias("want"), "have").where(F.abs(F.col("have") - F.col("want")) > UNMET * F.greatest(F.col("want"), F.lit(1.0)))
        _report(d, [tuple(r) for r in own.orderBy(F.desc(F.abs(F.col("have") - F.col("want")))).limit(SHOWN).collect()], kept)
    return table


def draw(seed: int):
    """A number in [0, 1) that depends on doc_id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, temper: dict[str, float] = TEMPER, fraction: float = FRACTION, topics: int = TOPICS, seed: int = 8, column: str = "_mix", most_cells: int = MOST_CELLS, targets: dict[str, dict] | None = None) -> DataFrame:
    """``docs`` with a struct column (tokens, topic, probability, kept).

    ``targets`` gives the shares of a dimension's values, such as {"lang": {"en": 0.6, None: 0.4}}, in place of tempered ones.
    """
    made = with_topics(docs, column, topics)
    source, lang = F.col("source").cast("string"), F.col("lang").cast("string")
    skinny = with_topics(docs.select("source", "lang", "text"), column, topics)
    cells = skinny.groupBy(source.alias("source"), lang.alias("lang"), F.col(f"{column}.topic").alias("topic")).agg(F.sum(f"{column}.tokens").alias("tokens")).where("tokens > 0")
    cells = Scratch(docs.sparkSession, "mixing").save(cells, "cells")
    p = cell_probabilities(cells, temper, fraction, most_cells, targets)
    cell, own = "_cell", "_probability"
    while {cell, own} & {c.lower() for c in made.columns}:
        cell, own = cell + "_", own + "_"
    p = p.select(F.struct("source", "lang", "topic").alias(cell), F.col("probability").alias(own))
    joined = made.join(p, (source.eqNullSafe(F.col(f"{cell}.source"))) & (lang.eqNullSafe(F.col(f"{cell}.lang"))) & (F.col(f"{column}.topic") == F.col(f"{cell}.topic")), "left")
    chance = F.when(F.col(f"{column}.tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(own, F.lit(0.0)))
    full = F.struct(F.col(f"{column}.tokens").alias("tokens"), F.col(f"{column}.topic").alias("topic"), chance.alias("probability"), (draw(seed) < chance).alias("kept"))
    return joined.withColumn(column, full).drop(cell, own)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, source, lang, topic, tokens, probability, kept."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "_mix.topic", "_mix.tokens", F.round("_mix.probability", 9).alias("probability"), "_mix.kept")
