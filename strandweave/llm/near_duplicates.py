"""Near-duplicate detection with b-bit MinHash (operator 5).

One pass over the texts makes, for each document, the set of its word shingles,
a 16-byte fingerprint of that set, 128 MinHash minima, 25 band keys of five
minima each and a packed signature that retains the low four bits of every
minimum (64 bytes).  Documents with equal sets are one *node*, numbered once.
Nodes that share a band key are candidates; their similarity is estimated from
the signatures by counting equal nibbles, corrected for the chance collisions
of four-bit values; a pair whose estimate is not clearly below the threshold
is confirmed on the full shingle sets with integer arithmetic.

Sets are large, so they are made (by reading those texts again) only for nodes
whose pair or bucket has passed the estimate, and travel once for each pair:

- Leader rounds.  Every bucket compares its members with one leader, and of all
  leaders a class meets, the one it shares the most bands with is confirmed.
  Linked classes merge (a forest of links, flattened by pointer jumping);
  buckets that hold a single class are done.  A group of copies that holds a
  third of all rows costs its size in each round, never its square.
- What is left.  In every bucket that still holds several classes, the members
  outside its largest class meet all members, in cells of bounded size, by
  signatures.  Members joined by passing estimates form groups, and a group
  (where it is large, its buckets once more) is compared by full sets.  Only
  spanning links leave a cell, so pairs are never listed and none is lost to a
  limit.

The only loss is MinHash's own: of two documents of similarity 0.85, no band is
shared with probability 4e-7 (0.80: 5e-5), and the estimate lies more than
SLACK below the threshold with probability 5e-6 (4e-5).

Edge cases: null, empty and blank texts have no shingles, are linked with
nothing and stay their own class.  Rows that repeat a doc_id are documents of
their own.  A class whose doc_ids are all null has a null component_id.  An
empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text as tx
from strandweave.llm.bits import BitTable
from strandweave.session import Scratch

HASHES, ROWS, BANDS = 128, 5, 25
LOW_BITS, WORDS = 4, HASHES * 4 // 64
#: Estimates may lie this far below the threshold (4.5 standard errors at 0.85) and still be confirmed.
SLACK = 0.145
#: Members of a bucket on either side of a cell, by signatures; by sets, also so many shingles on either side.
CELL, LOAD = 512, 1 << 18
_CHUNK = 1 << 15
SIGNATURE = [f"s{i}" for i in range(WORDS)]
_SKETCH = "doc_id long, digest long, node binary, n_shingles long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)


def minima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash minima (sets x HASHES, uint32) of concatenated non-empty sets."""
    a = (tx.odd_constants(HASHES, 11) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    b = (tx.odd_constants(HASHES, 13) >> np.uint64(17)).astype(np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), HASHES), np.uint32)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        part, starts = short[base : ends[hi - 1]], ends[lo:hi] - sizes[lo:hi] - base
        buffer = np.empty(len(part), np.uint32)
        for k in range(HASHES):
            np.multiply(part, a[k], out=buffer)
            np.add(buffer, b[k], out=buffer)
            out[lo:hi, k] = np.minimum.reduceat(buffer, starts)
        lo = hi
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    factors = tx.odd_constants(ROWS, 19)
    keys = np.zeros((len(low), BANDS), np.uint64)
    for j in range(ROWS):
        keys += low[:, j : ROWS * BANDS : ROWS].astype(np.uint64) * factors[j]
    return tx.mix64(keys ^ tx.odd_constants(BANDS, 23)[None, :]).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low LOW_BITS bits of every (mixed) minimum, 16 to a 64-bit word."""
    bits = tx.mix64(low.astype(np.uint64)) & np.uint64(15)
    shifts = (np.arange(16) * 4).astype(np.uint64)
    return (bits.reshape(len(low), WORDS, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


#: Leaders of a round are the members whose id, with these bits turned over, is least.
_TURNS = [(0x2545F4914F6CDD1D * r) & ((1 << 62) - 1) for r in range(16)]


def _nodes(sizes: np.ndarray, values: np.ndarray) -> list[bytes | None]:
    raw, ends = values.tobytes(), np.cumsum(sizes)
    return [hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() if n else None for n, e in zip(sizes, ends)]


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tx.slices(batch.column(2)):
            values, sizes = tx.text_shingles(data, offsets, width)
            full = sizes > 0
            low = minima(values, sizes[full])
            keys = np.zeros((len(sizes), BANDS), np.int64)
            signature = np.zeros((len(sizes), WORDS), np.int64)
            keys[full], signature[full] = band_keys(low), packed(low)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            own = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(_nodes(sizes, values), pa.binary()), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*own, bands, *(pa.array(np.ascontiguousarray(signature[:, i])) for i in range(WORDS))], names=["doc_id", "digest", "node", "n_shingles", "bands", *SIGNATURE])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of texts, each node once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for _, _, data, offsets in tx.slices(batch.column(0)):
            values, sizes = tx.text_shingles(data, offsets, width)
            nodes, ends = _nodes(sizes, values), np.cumsum(sizes)
            new = [i for i, node in enumerate(nodes) if node is not None and not (node in seen or seen.add(node))]
            if new:
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[new])]).astype(np.int32)), pa.array(np.concatenate([values[ends[i] - sizes[i] : ends[i]] for i in new]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.binary()), arrays], names=["node", "shingles"])


def most_unequal(threshold: float) -> int:
    """Signatures that differ in more nibbles have a collision-corrected estimate clearly below the threshold."""
    chance = 2.0**-LOW_BITS
    return int(HASHES - HASHES * ((threshold - SLACK) * (1 - chance) + chance))


def _estimate_passes(a: str, b: str, threshold: float):
    ones, unequal = F.lit(0x1111111111111111), F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    return unequal <= F.lit(most_unequal(threshold))


def _sizes_pass(a, b, num: int, den: int):
    """Condition: the sizes alone allow similarity num/den."""
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


class _Finder:
    """The classes of one table of texts: (id, class) of the nodes that are not a class of their own."""

    def __init__(self, docs: DataFrame, width: int, similarity: tuple[int, int], rounds: int):
        self.width, (self.num, self.den), self.rounds = width, similarity, rounds
        self.scratch = Scratch(docs.sparkSession, "near-duplicates")
        text = F.col("text").cast("string")
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.save(df, name)

    def rows(self) -> DataFrame:
        """Per document: doc_id, digest (of the text), n_shingles, class (null without shingles), component_id."""
        sketch = self.save(tx.map_texts(self.texts, lambda it, width=self.width: _sketch(it, width), _SKETCH), "sketch")
        nodes = sketch.where("node is not null").groupBy("node")
        nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "digest")).alias("first"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands"), *(F.max(s).alias(s) for s in SIGNATURE))
        nodes = self.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
        bands = nodes.select("id", F.explode("bands").alias("key"))
        shared = self.save(bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
        buckets = self.save(bands.join(shared, "key"), "buckets")
        self.scratch.drop("shared")
        wanted = self.save(buckets.select("id").distinct().join(nodes.drop("bands"), "id"), "wanted")
        names = self.save(nodes.select("node", "id", "doc_id"), "names")
        self.scratch.drop("nodes")
        self.scratch.release()
        moved = self.classes(buckets, wanted)
        # the smallest doc_id of every class of several nodes
        own = moved.unionByName(moved.select(F.col("class").alias("id"), "class").distinct())
        smallest = self.save(own.join(wanted.select("id", "doc_id"), "id").groupBy("class").agg(F.min("doc_id").alias("component_id")), "smallest")
        placed = self.save(own.join(smallest, "class"), "placed")
        label = names.join(placed, "id", "left").select("node", F.coalesce("class", "id").alias("class"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        label = self.save(label, "label")
        for name in ("wanted", "names", "smallest", "placed"):
            self.scratch.drop(name)
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return sketch.select("doc_id", "digest", "node", "n_shingles").join(label, "node", "left").select("doc_id", "digest", "n_shingles", "class", component.alias("component_id"))

    def classes(self, buckets: DataFrame, wanted: DataFrame) -> DataFrame:
        members, last = buckets.select("key", "id", F.col("id").alias("class")), "buckets"
        moved = self.save(wanted.select("id", F.col("id").alias("class")).where("false"), "moved")
        for step in range(self.rounds + 1):
            order = F.col("id").bitwiseXOR(F.lit(_TURNS[step]))
            span = members.groupBy("key", "class").agg(F.count("*").alias("c"), F.min(order).alias("b")).groupBy("key")
            span = span.agg(F.count("*").alias("classes"), (F.sum("c") - F.max("c")).alias("outside"), F.min("b").alias("b"), F.min_by("class", "b").alias("other"))
            span = self.save(span.where("classes > 1").select("key", F.col("b").bitwiseXOR(F.lit(_TURNS[step])).alias("b"), "other", "outside"), f"span{step}")
            opened = self.save(members.join(span, "key"), f"open{step}")
            for name in (last, f"span{step}", f"members{step}"):
                self.scratch.drop(name)
            last = f"open{step}"
            if opened.isEmpty():
                return moved
            # every bucket has one leader round; a further one is for buckets that would fill several cells
            hard = opened if step == 0 else opened.where(F.col("outside") > CELL)
            if step == self.rounds or step and hard.isEmpty():
                break
            links = self.leaders(hard, wanted, step)
            if not links.isEmpty():
                moved = _merge(self.scratch, moved, links, f"merge{step}", whole=False)
            members = self.save(_relabel(opened.select("key", "id"), moved), f"members{step + 1}")
            self.scratch.release()
        links = self.compared(opened.select("key", "id", "class"), wanted)
        if not links.isEmpty():
            moved = _merge(self.scratch, moved, links, "merge")
        self.scratch.drop(last)
        self.scratch.release()
        return moved

    def leaders(self, opened: DataFrame, wanted: DataFrame, step: int) -> DataFrame:
        """Links (class, other) between classes and one leader each."""
        met = opened.where("class <> other").groupBy("class", "other", "id", "b").agg(F.count("*").alias("c"))
        pairs = met.groupBy("class").agg(F.max_by("other", "c").alias("other"), F.max_by("id", "c").alias("a"), F.max_by("b", "c").alias("b"))
        signed = wanted.select("id", "n", *SIGNATURE)
        passes = _sizes_pass(F.col("x.n"), F.col("y.n"), self.num, self.den) & _estimate_passes("x", "y", self.num / self.den)
        pairs = pairs.join(signed.alias("x"), F.col("a") == F.col("x.id")).join(signed.alias("y"), (F.col("b") == F.col("y.id")) & passes).select("class", "other", "a", "b")
        pairs = self.save(pairs, f"pairs{step}")
        needed = pairs.select(F.col("a").alias("id"), F.lit(False).alias("leads")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(True).alias("leads")))
        sets = self.sets(needed.groupBy("id").agg(F.max("leads").alias("leads"), F.min("leads").alias("only_leads")), wanted, f"{step}")
        left = sets.where("not only_leads").select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.where("leads").select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        near = both * self.den >= (F.size("sa") + F.size("sb") - both) * self.num
        links = self.save(pairs.join(left, "a").join(right, "b").where(near).select("class", "other"), f"links{step}")
        for name in (f"pairs{step}", f"sets{step}"):
            self.scratch.drop(name)
        return links

    def sets(self, needed: DataFrame, wanted: DataFrame, tag: str) -> DataFrame:
        """``needed`` (id, ...) with the full shingle sets, made from one text of each node."""
        needed = self.save(needed.join(wanted.select("id", "node", "first"), "id"), f"needed{tag}")
        table = BitTable(self.scratch, f"bits{tag}", needed.select("first.doc_id", "first.digest"))
        texts = table.mark(self.texts, ["doc_id", "digest"], "hit").where("hit").select("text")
        made = tx.map_texts(texts, lambda it, width=self.width: _sets(it, width), "node binary, shingles array<long>")
        rest = [c for c in needed.columns if c not in ("node", "first")]
        made = made.join(needed.drop("first"), "node").groupBy("node").agg(*(F.first(c).alias(c) for c in (*rest, "shingles"))).drop("node")
        made = self.save(made, f"sets{tag}")
        for name in (f"needed{tag}", f"bits{tag}"):
            self.scratch.drop(name)
        return made

    def compared(self, members: DataFrame, wanted: DataFrame) -> DataFrame:
        """Links (class, other) among the members of each bucket, no pair of two classes left out.

        Members whose estimates allow links form groups; a group that fits a
        cell is compared in one, so that a set travels once and not once for
        each bucket; members of larger groups meet in their buckets.
        """
        num, den = self.num, self.den
        cells = self.dealt(members.withColumn("n", F.lit(0)), "by-signature").join(wanted.select("id", "n", *SIGNATURE), "id")
        cells = _placed(cells, "id", "n", *SIGNATURE)
        near = self.save(cells.mapInArrow(lambda it: _passing_cells(it, num, den), "class long, other long").distinct(), "near")
        if near.isEmpty():
            return near
        grouped = _merge(self.scratch, near.select(F.col("class").alias("id"), "class").where("false"), near, "groups")
        grouped = grouped.unionByName(grouped.select(F.col("class").alias("id"), "class").distinct()).select("id", F.col("class").alias("group"))
        grouped = self.save(grouped.join(wanted.select("id", "n"), "id"), "grouped")
        sizes = self.save(grouped.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("load")).select("group", ((F.col("c") <= CELL) & (F.col("load") <= LOAD)).alias("fits")), "sizes")
        grouped = self.save(grouped.join(sizes, "group"), "fitting")
        alone = members.select("id", "class").distinct().join(grouped.where("fits"), "id").select(F.col("group").alias("key"), "id", "class", "n")
        spread = members.join(grouped.where("not fits"), "id").select("key", "id", "class", "n")
        cells = self.save(self.dealt(self.save(alone.unionByName(spread), "weighed"), "by-set"), "cells")
        sets = self.sets(cells.select("id").distinct(), wanted, "cells")
        cells = _placed(cells.join(sets, "id"), "shingles")
        links = self.save(cells.mapInArrow(lambda it: _linked_cells(it, num, den), "class long, other long").distinct(), "links")
        for name in ("near", "grouped", "sizes", "fitting", "weighed", "cells", "setscells", "by-signature", "by-set"):
            self.scratch.drop(name)
        return links

    def dealt(self, members: DataFrame, tag: str) -> DataFrame:
        """(key, i, j, asks, answers, id, class): cells in which every member outside a bucket's largest class meets all others.

        Cell (i, j) holds block i of the members that ask and block j of all
        members, which answer; ``n`` bounds the weight of a block.
        """
        sizes = members.groupBy("key", "class").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("key")
        sizes = sizes.agg(F.max_by("class", "c").alias("major"), F.sum("c").alias("all"), F.sum("w").alias("load"), F.max("c").alias("c"), F.max_by("w", "c").alias("w"))
        parts = lambda count, load: F.greatest(F.ceil(count / CELL), F.ceil(load / LOAD), F.lit(1)).cast("long")
        blocks = self.save(sizes.select("key", "major", parts(F.col("all"), F.col("load")).alias("js"), parts(F.col("all") - F.col("c"), F.col("load") - F.col("w")).alias("is")), tag)
        placed = members.join(blocks, "key").withColumn("asks", F.col("class") != F.col("major"))
        placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("js"))).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), F.col("is")))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        answering = placed.withColumn("i", upto("is")).select("key", "i", F.col("own").alias("j"), (F.col("asks") & (F.col("i") == F.col("turn"))).alias("asks"), F.lit(True).alias("answers"), "id", "class")
        asking = placed.where("asks and js > 1").withColumn("j", upto("js")).where("j <> own").select("key", F.col("turn").alias("i"), "j", F.lit(True).alias("asks"), F.lit(False).alias("answers"), "id", "class")
        return answering.unionByName(asking)


def _placed(cells: DataFrame, *columns: str) -> DataFrame:
    return cells.select("key", "i", "j", "asks", "answers", "class", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _merge(scratch: Scratch, moved: DataFrame, links: DataFrame, tag: str, whole: bool = True) -> DataFrame:
    """(id, class) after joining classes along links (class, other): ``whole``, until no link joins two classes, else once."""
    step = 0
    while True:
        ends = links.select(F.greatest("class", "other").alias("id"), F.least("class", "other").alias("class")).where("id <> class")
        forest = _flatten(scratch, ends.groupBy("id").agg(F.min("class").alias("class")), f"{tag}-forest{step}")
        # a class that moves is named after a node that was a class of its own
        moved = scratch.save(_relabel(moved.select("id", F.col("class").alias("was")), forest, "was").select("id", "class").unionByName(forest), f"{tag}-classes{step}")
        if not whole:
            return moved
        links = _relabel(links.select(F.col("class").alias("was"), "other"), forest, "was").select("other", F.col("class").alias("x"))
        links = _relabel(links, forest, "other").select("class", F.col("x").alias("other")).where("class <> other").distinct()
        links, step = scratch.save(links, f"{tag}-links{step}"), step + 1
        if links.isEmpty():
            return moved


def _relabel(df: DataFrame, classes: DataFrame, column: str = "id") -> DataFrame:
    """``df`` with the class of ``column``: its own value where ``classes`` has none."""
    return df.join(classes.select(F.col("id").alias(column), "class"), column, "left").withColumn("class", F.coalesce("class", column))


def _flatten(scratch: Scratch, forest: DataFrame, tag: str) -> DataFrame:
    """Roots of a forest given as (id, class) with class < id, by pointer jumping, two jumps a step."""
    step = 0
    while True:
        up, upper = (forest.select(F.col("id").alias(c), F.col("class").alias(above)) for c, above in (("class", "above"), ("above", "top")))
        nxt = forest.join(up, "class", "left").join(upper, "above", "left").select("id", F.coalesce("top", "above", "class").alias("class"), F.col("top").isNotNull().alias("far"))
        nxt = scratch.save(nxt, f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}")
        forest, step = nxt.select("id", "class"), step + 1
        if nxt.where("far").isEmpty():
            return forest


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one (key, i, j) at a time, of batches sorted by them."""
    cell, waiting = None, []
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if cell != tuple(keys[lo]):
                if waiting:
                    yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if len(waiting) > 1 else waiting[0]
                cell, waiting = tuple(keys[lo]), []
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if len(waiting) > 1 else waiting[0]


def _flags(cell: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return cell.column(3).to_numpy(zero_copy_only=False), cell.column(4).to_numpy(zero_copy_only=False)


def passing(ids, classes, asks, answers, sizes, signatures, num: int, den: int) -> np.ndarray:
    """A spanning set of the pairs of ids, of two classes, whose sizes and estimates allow a link."""
    most, answering = most_unequal(num / den), np.flatnonzero(answers)
    root, found = np.arange(len(ids)), []
    for lo in range(0, len(asking := np.flatnonzero(asks)), 64):
        part = asking[lo : lo + 64]
        x = signatures[part][:, None, :] ^ signatures[answering][None, :, :]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2)
        m, n = sizes[part][:, None], sizes[answering][None, :]
        near = (unequal <= most) & (classes[part][:, None] != classes[answering][None, :]) & (np.minimum(m, n) * den >= np.maximum(m, n) * num)
        for i in np.flatnonzero(near.any(axis=1)):
            partners, own = answering[near[i]], part[i]
            for c, first in zip(*np.unique(root[partners], return_index=True)):
                if c != root[own]:
                    found.append((ids[own], ids[partners[first]]))
                    root[root == c] = root[own]
    return np.array(found, np.int64).reshape(-1, 2)


def _passing_cells(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    found: list[np.ndarray] = []
    for cell in _by_cell(batches):
        classes, ids, sizes = (np.asarray(cell.column(c)) for c in (5, 6, 7))
        signatures = np.stack([np.asarray(cell.column(8 + s)) for s in range(WORDS)], axis=1).view(np.uint64)
        found.append(passing(ids, classes, *_flags(cell), sizes, signatures, num, den))
        if len(found) >= 4096:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _linked_cells(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    found: list[np.ndarray] = []
    for cell in _by_cell(batches):
        sets = cell.column(6)
        offsets = np.asarray(sets.offsets)
        found.append(linked(np.asarray(cell.column(5)), *_flags(cell), np.asarray(sets.values)[offsets[0] : offsets[-1]], np.diff(offsets), num, den))
    yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["class", "other"])


def linked(classes: np.ndarray, asks: np.ndarray, answers: np.ndarray, values: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A spanning set of links (class, other) found between members that ask and members that answer."""
    names, at = np.unique(classes, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    vocabulary, flat = np.unique(values, return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int32)
    root, found = np.arange(len(names)), []
    for i in np.flatnonzero(asks):
        if (root[at[answers]] == root[at[i]]).all():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        near = answers & (both * den >= (sizes + sizes[i] - both) * num)
        for c in np.unique(root[at[near]]):
            if c != root[at[i]]:
                found.append((names[c], names[root[at[i]]]))
                root[root == c] = root[at[i]]
    return np.array(found, np.int64).reshape(-1, 2)


def duplicate_classes(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), rounds: int = 3) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id of its class), kept.

    ``similarity`` is the fraction num/den two sets must reach; ``rounds``
    bounds the leader rounds, not what is compared.
    """
    rows = _Finder(docs, width, similarity, rounds).rows()
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), rounds: int = 3) -> DataFrame:
    """``docs`` with one row of each class: of its smallest doc_id (null where it has no other), the text of least hash.

    Rows without shingles all stay.  Only rows that can be dropped are
    shuffled; all others pass a bit table.  Column names of the input are free.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    rows = _Finder(docs, width, similarity, rounds).rows().where("class is not null")
    rows = scratch.save(rows.select("doc_id", "digest", "class", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("head")), "rows")
    # where several rows have their class's smallest doc_id, one text of them stays
    ties = rows.where("head").groupBy("class").agg(F.count("*").alias("c"), F.min("digest").alias("least")).where("c > 1").select("class", "least")
    ties = scratch.save(ties, "ties")
    tied = rows.where("head").join(ties, "class")
    out = rows.where("not head").select("doc_id", "digest").unionByName(tied.where("digest <> least").select("doc_id", "digest"))
    out = scratch.save(out, "out")
    doubtful = scratch.save(out.unionByName(tied.where("digest = least").select("doc_id", "digest")), "doubtful")
    table = BitTable(scratch, "bits", doubtful)
    names = iter(_free(docs, "_doc", "_digest", "_hit"))
    doc, digest, hit = next(names), next(names), next(names)
    text = F.col("text").cast("string")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, F.xxhash64(text))
    worded = F.coalesce(F.length(F.trim(text, F.lit(" \t\n\x0b\x0c\r"))) > 0, F.lit(False))
    marked = table.mark(keyed, [doc, digest], hit).withColumn(hit, F.col(hit) & worded)
    gone = out.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"))
    left = marked.where(F.col(hit)).join(gone, F.col(doc).eqNullSafe(F.col("_d")) & (F.col(digest) == F.col("_g")), "left_anti").dropDuplicates([doc, digest])
    return marked.where(~F.col(hit)).unionByName(left).select(*docs.columns)


def _free(docs: DataFrame, *names: str) -> list[str]:
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def near_duplicate_query(spark, sf_dir: str) -> DataFrame:
    """Contract of op5: three-word shingles, 100 * intersection >= 85 * union."""
    return duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (85, 100))


#: Brute force in SQL: every pair that shares a shingle, counted exactly, and reachability by recursion.
NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS o, doc_id AS v FROM n UNION SELECT r.o, l.y FROM r JOIN l ON l.x = r.v),
m AS (SELECT o, min(v) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
       coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.o = d.doc_id
"""
