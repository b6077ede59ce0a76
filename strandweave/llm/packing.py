"""Packing documents into training sequences as a cutting-stock problem (operator 1).

Every document is tokenised once; each full window of ``length`` tokens is a
sequence of its own, the remaining tail (shorter than a sequence) is an item.
Tails are counted by size class (``width`` tokens a class), and the linear
program "fewest sequences that hold all items" is solved by column generation:
a knapsack dynamic program over class sizes prices new patterns with the duals
of a revised simplex.  Pattern counts are rounded down and scaled so that the
patterned sequences cannot exceed the tokens there are; documents are ranked
within their class and rank r falls into one pattern instance by arithmetic,
so the assignment needs neither a sort nor a driver list.  The few documents
beyond the rounded patterns are cut freely: their tokens fill what the
patterns leave open, and the rest makes full sequences and, at the very end,
sequences whose lengths are powers of two, which need no padding.  Padding is
therefore zero.

The driver sees one row per size class (at most ``length / width``).  Ranks
come from counters inside each task of the tokenising pass, whose result is a
written table, so they do not change when an executor is lost.

Edge cases: a null or empty text is a document of the end token alone; an
empty table gives no pieces; repeated rows and repeated doc_ids are packed
each on its own; other columns are ignored.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm import text as tx
from strandweave.llm.tokens import encoder
from strandweave.session import Scratch

LOG = logging.getLogger(__name__)

LENGTH, WIDTH, END = 4096, 32, 2
_SCHEMA = "part int, row long, doc_id long, doc_tokens long, fulls array<long>, first_full long, tail int, tail_crc long, cls int, rank long, tail_ids binary, ids binary"


# ---------------------------------------------------------------- the linear program


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts for an unbounded knapsack with integer sizes."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for u in range(1, capacity + 1):
        best[u] = best[u - 1]
        usable = sizes <= u
        gains = np.where(usable, values + best[np.maximum(u - sizes, 0)], -1.0)
        k = int(np.argmax(gains))
        if gains[k] > best[u] + 1e-12:
            best[u], choice[u] = gains[k], k
    counts, u = np.zeros(len(sizes), np.int64), capacity
    while u > 0:
        if choice[u] < 0:
            u -= 1
        else:
            counts[choice[u]] += 1
            u -= int(sizes[choice[u]])
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, sizes: np.ndarray, capacity: int, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts that meet ``demand`` with fewest stocks."""
    m = len(demand)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    counts = demand / np.diag(patterns)
    for _ in range(steps):
        duals = inverse.sum(axis=0)
        value, column = knapsack(np.maximum(duals, 0.0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.full(m, np.inf)
        ratios[up] = counts[up] / direction[up]
        leave = int(np.argmin(ratios))
        counts = counts - direction * ratios[leave]
        counts[leave] = ratios[leave]
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        patterns[:, leave] = column
    else:
        LOG.warning("packing: column generation stopped after %d columns; its patterns are feasible, not proven best", steps)
    return patterns, np.maximum(counts, 0.0)


def rounded(patterns: np.ndarray, counts: np.ndarray, demand: np.ndarray, most: int) -> np.ndarray:
    """Whole pattern counts, at most ``most`` in all, that use no class beyond its demand."""
    whole = np.floor(counts * min(1.0, most / max(counts.sum(), 1e-9)) + 1e-9).astype(np.int64)
    for p in np.argsort(-whole, kind="stable"):
        while whole[p] and (patterns @ whole > demand).any():
            whole[p] -= 1
    return whole


# ---------------------------------------------------------------- tokenising


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, length: int, width: int, end: int, keep: bool, specials_as_text: bool) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    coder, tail_end = encoder(path, specials_as_text=specials_as_text), np.array([end], "<u4").tobytes()
    seen: dict[int, int] = {}
    row = fulls_seen = 0
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    for batch in batches:
        for lo, hi, _, _ in tx.slices(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo)
            out: dict[str, list] = {n: [] for n in names if n != "doc_id"}
            texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            for raw in coder.encode(texts):
                raw += tail_end
                n = len(raw) // 4
                cut = n - n % length
                rest = raw[4 * cut :]
                cls = -(-(n - cut) // width)
                rank = seen.get(cls, 0)
                seen[cls] = rank + 1
                fulls = [zlib.crc32(raw[4 * s : 4 * (s + length)]) for s in range(0, cut, length)]
                for name, value in zip(out, (part, row, n, fulls, fulls_seen, n - cut, zlib.crc32(rest), cls, rank, rest, raw if keep else None)):
                    out[name].append(value)
                row += 1
                fulls_seen += len(fulls)
            kinds = {"part": pa.int32(), "tail": pa.int32(), "cls": pa.int32(), "fulls": pa.list_(pa.int64()), "tail_ids": pa.binary(), "ids": pa.binary()}
            columns = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()} | {"doc_id": ids}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _piece_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column tail_ids by the checksum of the cut that ``at`` and ``length`` name."""
    for batch in batches:
        t = batch.to_pydict()
        crcs = [zlib.crc32(b[4 * a : 4 * (a + n)]) for b, a, n in zip(t["tail_ids"], t["at"], t["length"])]
        names = [n for n in batch.schema.names if n != "tail_ids"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"])


# ---------------------------------------------------------------- prefix sums


def prefix_sums(df: DataFrame, key: str, value: str, n: int, out: str, block: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows with a smaller ``key``; keys are 0..n-1.

    Sums inside blocks of keys, then over block totals, again in blocks where
    there are many, so that no task reads more than a few thousand rows.
    """
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = df.withColumn("_block", F.expr(f"{key} div {block}"))
    local = cut.withColumn(out, F.sum(value).over(inside) - F.col(value))
    totals = cut.groupBy("_block").agg(F.sum(value).alias("_total"))
    blocks = -(-n // block)
    offset = f"_before_{out}"  # longer at each level, so that no two levels share a name
    if blocks <= 16 * block:
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(offset))
    else:
        offsets = prefix_sums(totals.withColumnRenamed("_block", "_key"), "_key", "_total", blocks, offset, block).select(F.col("_key").alias("_block"), offset)
    return local.join(offsets, "_block").withColumn(out, F.col(out) + F.col(offset)).drop("_block", offset)


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, width: int = WIDTH, end: int = END, with_ids: bool = False, specials_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids array<long>).

    The string of a special token inside a text gets that token's id, as the
    tokenizer's file has it; with ``specials_as_text`` it is ordinary text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.save(tx.map_texts(source, lambda it: _tokenise(it, tokenizer, length, width, end, with_ids, specials_as_text), _SCHEMA), "tokens")

    counted = tokens.where("tail > 0").groupBy("cls").agg(F.count("*").alias("n"), F.sum("tail").alias("t")).orderBy("cls").collect()
    demand = np.array([r["n"] for r in counted], np.int64)
    classes = np.array([r["cls"] for r in counted], np.int64)
    held = int(sum(r["t"] for r in counted))
    if len(counted):
        patterns, counts = column_generation(demand.astype(float), classes, length // width)
        whole = rounded(patterns, counts, demand, held // length)
    else:
        patterns, whole = np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    made = int(whole.sum())
    slots, limits = _slots(classes, demand, patterns, whole)
    slots = spark.createDataFrame(slots, "cls int, lo long, hi long, per long, base long, place long")
    limits = spark.createDataFrame(limits, "cls int, used long, spare long")

    # ranks over the whole table: the counters of each task plus what the tasks before it have
    sizes = tokens.where("tail > 0").groupBy("part", "cls").agg(F.count("*").alias("c")).unionByName(tokens.groupBy("part").agg(F.sum(F.size("fulls")).alias("c")).withColumn("cls", F.lit(0)))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.save(sizes.select("part", "cls", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("long").alias("off")), "offsets")
    tails = tokens.where("tail > 0").join(offsets.where("cls > 0"), ["part", "cls"]).withColumn("rank", F.col("rank") + F.col("off"))
    tails = tails.join(F.broadcast(limits), "cls").withColumn("at_doc", F.col("doc_tokens") - F.col("tail"))
    key = ["part", "row"]

    # patterned tails
    # both tables are bounded: a row for each class of each pattern, at most (length / width) squared
    placed = tails.where("rank < used").select(*key, "doc_id", "doc_tokens", "tail", "tail_crc", "cls", "rank", "at_doc")
    placed = placed.join(F.broadcast(slots), (placed.cls == slots.cls) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        *key, "doc_id", "doc_tokens", F.col("at_doc").alias("start"), F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"),
        F.expr("base + (rank - lo) div per").alias("sequence_id"), F.expr("place + (rank - lo) % per").alias("place"))
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = scratch.save(placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("place"), "placed")

    # free tails: a stream of tokens that fills whole sequences first, then what patterns leave open
    free = tails.where("rank >= used").withColumn("item", F.col("rank") - F.col("used") + F.col("spare"))
    n_free = int(demand.sum() - (patterns @ whole).sum()) if len(counted) else 0
    free = scratch.save(free.select(*key, "doc_id", "doc_tokens", "at_doc", F.col("tail").cast("long").alias("tail"), "tail_ids", "item"), "free")
    stream = prefix_sums(free.select("item", "tail"), "item", "tail", n_free, "lo")
    left = held - made * length
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("room", length - F.col("used"))
    gaps = prefix_sums(gaps, "sequence_id", "room", made, "lo").where("room > 0").select("sequence_id", "used", "room", (F.col("lo") + left).alias("lo"))
    extra = spark.range(left // length).select((F.col("id") + made).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(length).cast("long").alias("room"), (F.col("id") * length).alias("lo"))
    ends, at, number = [], left - left % length, made + left // length
    for bit in (1 << b for b in reversed(range(length.bit_length())) if left % length & 1 << b):
        ends.append((number, 0, bit, at))
        at, number = at + bit, number + 1
    gaps = gaps.unionByName(extra).unionByName(spark.createDataFrame(ends, "sequence_id long, used long, room long, lo long"))
    block = lambda lo, n: F.explode(F.expr(f"sequence({lo} div {length}, ({lo} + {n} - 1) div {length})"))
    s = stream.withColumn("b", block("lo", "tail")).alias("s")
    g = gaps.withColumn("b", block("lo", "room")).alias("g")
    lo, hi = F.greatest("s.lo", "g.lo"), F.least(F.col("s.lo") + F.col("s.tail"), F.col("g.lo") + F.col("g.room"))
    cuts = s.join(g, (F.col("s.b") == F.col("g.b")) & (lo < hi) & (F.floor(lo / length) == F.col("s.b"))).select(
        "item", "sequence_id", (lo - F.col("s.lo")).alias("at"), (hi - lo).alias("length"), (F.col("used") + lo - F.col("g.lo")).alias("offset"))
    cuts = cuts.join(free.select("item", *key, "doc_id", "doc_tokens", "at_doc", "tail_ids"), "item")
    kinds = "part int, row long, doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, at long, ids_crc32 long"
    cuts = cuts.select(*key, "doc_id", "doc_tokens", (F.col("at_doc") + F.col("at")).alias("start"), "length", "sequence_id", "offset", "at", "tail_ids").mapInArrow(_piece_crcs, kinds).drop("at")

    # full windows
    first = number
    fulls = tokens.where("size(fulls) > 0").join(offsets.where("cls = 0").select("part", "off"), "part")
    fulls = fulls.select(*key, "doc_id", "doc_tokens", "first_full", "off", F.posexplode("fulls").alias("i", "ids_crc32")).select(
        *key, "doc_id", "doc_tokens", (F.col("i") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32",
        (F.col("first_full") + F.col("off") + F.col("i") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = placed.unionByName(cuts).unionByName(fulls)
    if not with_ids:
        return pieces.select(*columns)
    whole_ids = tokens.select(*key, "ids")
    pieces = pieces.join(whole_ids, key).select(*columns, F.expr("substring(ids, 4 * start + 1, 4 * length)").alias("ids"))
    return pieces.mapInArrow(_as_lists, pieces.select(*columns).schema.simpleString()[7:-1].replace(":", " ") + ", ids array<long>")


def _as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in batch.column("ids").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=batch.schema.names)


def _slots(classes: np.ndarray, demand: np.ndarray, patterns: np.ndarray, whole: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """For each class of each pattern: the ranks it takes, how many a sequence takes, its first sequence
    and its place in the pattern; for each class: ranks in patterns, and the free items before it."""
    slots, taken = [], np.zeros(len(classes), np.int64)
    base = 0
    for p, times in enumerate(whole):
        place = 0
        for c in np.flatnonzero(patterns[:, p]) if times else ():
            per = int(patterns[c, p])
            slots.append((int(classes[c]), int(taken[c]), int(taken[c] + per * times), per, base, place))
            taken[c] += per * times
            place += per
        base += int(times)
    spare = np.cumsum(demand - taken) - (demand - taken)
    return slots, [(int(c), int(t), int(s)) for c, t, s in zip(classes, taken, spare)]


def packing_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
