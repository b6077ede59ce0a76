"""Repeated words and compacted arcs of sequences that no task could hold.

A long sequence comes as chunks: rows (seq_id, n, start, seq), where ``start``
is the place of the chunk's first letter and ``n`` the length of the whole
circular sequence, over A, C, G, T.  Chunks of any lengths, in any order, are
cut anew into blocks of ``BLOCK`` places; a block also has the k-1 letters
that follow it, so every word lies whole in the block it starts in.

The words of a block go out as super-words: stretches of consecutive words
that share their minimizer, the word of ``m`` letters of least hash inside
them.  Equal words have equal minimizers, so dealing super-words out by (sequence,
minimizer) brings all occurrences of a word into one task, and a stretch of r
words travels as r+k-1 letters.  A task reads its super-words sorted by
minimizer and remembers, of the minimizer it is at, one place for each
different word; a second occurrence gives both places out at once.  So the
memory of a task depends neither on the length of a sequence nor on the number
of copies of a word, only on the number of different words of one minimizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequences import reverse_complement
from strandweave.session import Scratch

#: Places of a block; places of a stretch that one task orders.
BLOCK, STRETCH = 1 << 16, 1 << 20
#: Most words of a super-word, and words that a task takes at a time.
LONGEST, WORDS = 256, 1 << 17
#: Letters in one 64-bit code.
LETTERS = 31
#: The four letters of each byte of a code.
FOUR = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]
CHUNK = "seq_id long, strand int, n long, start long, seq string"


def chunked(seqs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Chunks of (seq_id, seq) rows that are at hand as a whole; each is cut in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(1)[i].as_py() or ""
                for lo in range(0, len(s), size):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([0], pa.int32()), pa.array([len(s)]), pa.array([lo]), pa.array([s[lo : lo + size]])], names=["seq_id", "strand", "n", "start", "seq"])

    return seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").mapInArrow(run, CHUNK)


def joined(parts: DataFrame, order: str, shard) -> DataFrame:
    """Chunks of the circular sequences that rows (seq_id, seq) make in the order of the column ``order``.

    ``shard`` never decreases along the order: places are summed inside shards,
    and over the shards of a sequence, so no task orders a whole sequence.
    """
    sized = parts.select(F.col("seq_id").cast("long").alias("seq_id"), F.col(order).alias("_o"), shard.alias("_s"), "seq", F.length("seq").cast("long").alias("_n"))
    inside = Window.partitionBy("seq_id", "_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("seq_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shards = sized.groupBy("seq_id", "_s").agg(F.sum("_n").alias("_t"))
    zero = F.lit(0).cast("long")
    shards = shards.select("seq_id", "_s", F.coalesce(F.sum("_t").over(before), zero).alias("_b"), F.sum("_t").over(Window.partitionBy("seq_id")).alias("n"))
    placed = sized.withColumn("_i", F.coalesce(F.sum("_n").over(inside), zero)).join(shards, ["seq_id", "_s"])
    return placed.where("_n > 0").select("seq_id", F.lit(0).alias("strand"), "n", (F.col("_b") + F.col("_i")).alias("start"), "seq")


def both_strands(chunks: DataFrame) -> DataFrame:
    """The chunks, and as strand 1 those of the reverse complements."""
    other = chunks.select("seq_id", F.lit(1).alias("strand"), "n", (F.col("n") - F.col("start") - F.length("seq")).alias("start"), reverse_complement("seq").alias("seq"))
    return chunks.withColumn("strand", F.lit(0)).unionByName(other)


def blocks(chunks: DataFrame, k: int, size: int | None = None) -> DataFrame:
    """(seq_id, strand, block, seq): block b has the places from b * size on, and k-1 letters more.

    Every piece of a chunk goes to the block, or the two, that it belongs to;
    the first k-1 letters also follow the last ones.
    """
    size = size or BLOCK
    whole = chunks.where((F.col("n") >= k) & (F.length("seq") > 0)).select("seq_id", "strand", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), "seq")
    # (a, e): where the chunk is on the line that goes on for k-1 letters beyond the circle
    turns = whole.withColumn("a", F.explode(F.when(F.col("start") < k - 1, F.array("start", F.col("start") + F.col("n"))).otherwise(F.array("start"))))
    turns = turns.withColumn("e", F.col("a") + F.length("seq"))
    spread = turns.withColumn("block", F.explode(F.expr(f"sequence(least(greatest(a - {k - 1}, 0) div {size}, (n - 1) div {size}), least((e - 1) div {size}, (n - 1) div {size}))")))
    lo = F.greatest("a", F.col("block") * size)
    hi = F.least(F.col("e"), F.least((F.col("block") + 1) * size, F.col("n")) + (k - 1))
    pieces = spread.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    pieces = pieces.select("seq_id", "strand", "block", "lo", F.substring("seq", (F.col("lo") - F.col("a") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("piece"))
    together = pieces.groupBy("seq_id", "strand", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "piece"))).alias("p"))  # at most size + k-1 letters
    return together.select("seq_id", "strand", "block", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def _letters(raw: bytes) -> np.ndarray:
    code = np.full(256, 255, np.uint8)
    code[list(b"ACGT")] = range(4)
    found = code[np.frombuffer(raw, np.uint8)]
    if (found == 255).any():
        raise ValueError("a sequence has letters outside ACGT")
    return found


def _codes(letters: np.ndarray, k: int) -> np.ndarray:
    """Two-bit codes of the k letters from each place on, as columns of at most ``LETTERS`` letters."""
    n = max(len(letters) - k + 1, 0)
    powers = [letters.astype(np.int64)]  # of 1, 2, 4, ... letters, each from two of the power below
    for i in range(min(k, LETTERS).bit_length() - 1):
        powers.append(powers[i][: -(1 << i)] << (2 << i) | powers[i][1 << i :])
    columns = []
    for lo in range(0, k, LETTERS):
        code, at = np.zeros(n, np.int64), lo
        for i, power in reversed(list(enumerate(powers))):
            if min(LETTERS, k - lo) >> i & 1:
                code = code << (2 << i) | power[at : at + n]
                at += 1 << i
        columns.append(code)
    return np.stack(columns)


def _mixed(x: np.ndarray) -> np.ndarray:
    """An order of short words that favours none of low complexity (multiply and shift)."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def super_words(k: int, m: int, size: int):
    """Of blocks: (seq_id, strand, pos, minimizer, letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq_id, strand, block, seq = (batch.column(c)[i].as_py() for c in range(4))
                raw = seq.encode()
                order = _mixed(_codes(_letters(raw), m)[0])
                n = len(raw) - k + 1
                least = order[:n].copy()
                for j in range(1, k - m + 1):
                    np.minimum(least, order[j : j + n], out=least)
                cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                ends = np.append(cuts[1:], n)
                times = -(-(ends - cuts) // LONGEST)
                starts = np.repeat(cuts, times) + LONGEST * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                ends = np.minimum(starts + LONGEST, np.repeat(ends, times))
                parts = [raw[a : b + k - 1] for a, b in zip(starts.tolist(), ends.tolist())]
                count = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(seq_id, pa.int64()), count), pa.repeat(pa.scalar(strand, pa.int32()), count), pa.array(starts + block * size), pa.array(least[starts]), pa.array(parts, pa.binary())],
                    names=["seq_id", "strand", "pos", "minimizer", "letters"])

    return run


class _Seen:
    """Occurrences in the order of minimizers; gives out those of words that occur again."""

    def __init__(self, k: int):
        self.k, self.columns = k, -(-k // LETTERS)
        # seq_id, minimizer, code columns, strand, pos, given out
        self.held = [np.zeros(0, np.int64) for _ in range(self.columns + 5)]

    def words(self, rows: pa.RecordBatch) -> list[np.ndarray]:
        letters = rows.column("letters")
        offsets = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset : letters.offset + len(letters) + 1].astype(np.int64)
        flat = _letters(letters.buffers()[2][offsets[0] : offsets[-1]])
        counts = np.diff(offsets) - self.k + 1
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        codes = _codes(flat, self.k)[:, within + np.repeat(offsets[:-1] - offsets[0], counts)]
        seq, strand, pos, minimizer = (np.repeat(np.asarray(rows.column(c), np.int64), counts) for c in ("seq_id", "strand", "pos", "minimizer"))
        return [seq, minimizer, *codes, strand, pos + within, np.zeros(len(pos), np.int64)]

    def add(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        now = [np.concatenate(x) for x in zip(self.held, self.words(rows))]
        last = now[0][-1], now[1][-1]  # the rows are sorted, so only words of the last minimizer can come again
        word = now[2 : 2 + self.columns]
        if now[0][0] != last[0]:  # words of several sequences
            word = [now[0], *word]
        order = np.lexsort(word[::-1]) if len(word) > 1 else np.argsort(word[0])
        now, word = [x[order] for x in now], [x[order] for x in word]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in word], axis=0)
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        out = again & (now[-1] == 0)
        now[-1] |= again
        given = self._given([x[out] for x in now])
        keep = new & (now[0] == last[0]) & (now[1] == last[1])
        said = np.maximum.reduceat(now[-1], np.flatnonzero(new))[group[keep]]
        self.held = [*(x[keep] for x in now[:-1]), said]
        return given

    def _given(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        spelt = [FOUR[rows[2 + c].astype(">i8").view(np.uint8).reshape(n, 8)].reshape(n, 32)[:, 32 - min(LETTERS, self.k - c * LETTERS) :] for c in range(self.columns)]
        letters = np.concatenate(spelt, axis=1)
        kmer = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * self.k), pa.py_buffer(letters.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[-3].astype(np.int32)), pa.array(rows[-2]), kmer], names=["seq_id", "strand", "pos", "kmer"])


def _repeated(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(k)
        step = max(1, WORDS // LONGEST)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                found = seen.add(batch.slice(lo, step))
                if found.num_rows:
                    yield found

    return run


def repeated_words(chunks: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """(seq_id, strand, pos, kmer) of the words that occur more than once in their sequence, its strands together."""
    m = min(k, m or 11)
    if not 1 <= m <= LETTERS:
        raise ValueError(f"a minimizer has from 1 to {LETTERS} letters")
    made = blocks(chunks, k).mapInArrow(super_words(k, m, BLOCK), "seq_id long, strand int, pos long, minimizer long, letters binary")
    dealt = made.repartition("seq_id", "minimizer").sortWithinPartitions("seq_id", "minimizer")
    return dealt.mapInArrow(_repeated(k), "seq_id long, strand int, pos long, kmer string")


def next_on_circle(found: DataFrame, sizes: DataFrame, stretch: int | None = None) -> DataFrame:
    """Each occurrence with the next one on its circle (``head``) and the way to it (``span``).

    A stretch of places is ordered by one task; the first occurrence of the
    next stretch that has one follows its last.  ``sizes`` is (seq_id, n).
    Of the first occurrences, a row a stretch, only the places are broadcast.
    """
    stretch = stretch or STRETCH
    key = ["seq_id", "strand", "_s"]
    cut = Scratch(found.sparkSession, "occurrences").save(found, "found").withColumn("_s", F.expr(f"pos div {stretch}"))  # found once, read three times
    ahead = F.lead(F.struct("pos", "kmer")).over(Window.partitionBy(*key).orderBy("pos"))
    ring = Window.partitionBy("seq_id", "strand").orderBy("_s")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = cut.groupBy(*key).agg(F.min("pos").alias("pos"))
    heads = cut.join(F.broadcast(least), [*key, "pos"]).select(*key, F.struct("pos", "kmer").alias("first")).join(sizes, "seq_id")
    wrapped = F.struct((F.first("first.pos").over(whole) + F.col("n")).alias("pos"), F.first("first.kmer").over(whole).alias("kmer"))
    heads = heads.select(*key, F.coalesce(F.lead("first").over(ring), wrapped).alias("_after"))
    out = cut.withColumn("_ahead", ahead).join(heads, key).withColumn("_next", F.coalesce("_ahead", "_after"))
    return out.select("seq_id", "strand", "pos", "kmer", F.col("_next.kmer").alias("head"), (F.col("_next.pos") - F.col("pos")).alias("span"))


def compacted_arcs(chunks: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """Arcs between consecutive repeated words: seq_id, strand, pos, tail, head, span."""
    sizes = chunks.groupBy("seq_id").agg(F.max("n").cast("long").alias("n"))
    arcs = next_on_circle(repeated_words(chunks, k, m), sizes)
    return arcs.select("seq_id", "strand", "pos", F.col("kmer").alias("tail"), "head", "span")
