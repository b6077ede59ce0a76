"""Multigraphs as arc tables (graph_id, u, v, m): degrees, predicates, rewrites, components.

Everything here is relational; iterative operators write their state to the
session's shared folder each round, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.session import Scratch


def walk_arcs(events: DataFrame, graph: str, order: list[str], symbol: str, shard=None) -> DataFrame:
    """Arc multigraph of each circular walk: consecutive symbols, the last followed by the first.

    ``shard`` is a column that never decreases along the order (a day of a time
    stamp, say).  With it a walk is cut into shards that are ordered by
    different tasks, and only the first symbol of each shard is ordered by
    walk, so one very long walk does not land in one task.
    """
    cut = events.select(F.col(graph).alias("graph_id"), F.col(symbol).alias("u"), *order, (F.lit(0) if shard is None else shard).alias("_s"))
    inside = Window.partitionBy("graph_id", "_s").orderBy(*order)
    heads = cut.groupBy("graph_id", "_s").agg(F.min_by("u", F.struct(*order)).alias("first"))
    ring = Window.partitionBy("graph_id").orderBy("_s")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("graph_id", "_s", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after")).hint("merge")
    steps = cut.withColumn("v", F.lead("u").over(inside)).join(heads, ["graph_id", "_s"])
    return steps.select("graph_id", "u", F.coalesce("v", "after").alias("v")).groupBy("graph_id", "u", "v").agg(F.count("*").alias("m"))


def ahead(rows: DataFrame, key: str, order: str, value, shard) -> DataFrame:
    """Adds ``ahead``: ``value`` of the next row of the same key in the order (null for the last).

    ``shard`` never decreases along the order; a shard is ordered by one task,
    and only the first row of each shard is ordered by key, so a key that holds
    most rows does not land in one task.
    """
    cut = rows.withColumn("_value", value).withColumn("_s", shard)
    inside = Window.partitionBy(key, "_s").orderBy(order)
    heads = cut.groupBy(key, "_s").agg(F.min_by("_value", order).alias("_first"))
    heads = heads.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.lead("_first").over(Window.partitionBy(key).orderBy("_s")).alias("_after"))
    met = cut.withColumn("_next", F.lead("_value").over(inside)).join(heads, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
    return met.withColumn("ahead", F.coalesce("_next", "_after")).drop("_value", "_s", "_next", "_k", "_t", "_after")


def degrees(arcs: DataFrame) -> DataFrame:
    """(graph_id, v, indegree, outdegree) with multiplicity, loops included."""
    ends = arcs.select("graph_id", F.col("u").alias("v"), F.lit(0).cast("long").alias("i"), F.col("m").alias("o")).unionByName(arcs.select("graph_id", "v", F.col("m").alias("i"), F.lit(0).cast("long").alias("o")))
    return ends.groupBy("graph_id", "v").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def balance(arcs: DataFrame) -> DataFrame:
    """(graph_id, vertices, balanced): whether every in-degree equals its out-degree."""
    return degrees(arcs).groupBy("graph_id").agg(F.count("*").alias("vertices"), F.bool_and(F.col("indegree") == F.col("outdegree")).alias("balanced"))


def branch_degrees(arcs: DataFrame) -> DataFrame:
    """(graph_id, degrees): sorted out-degrees above one, as text."""
    big = degrees(arcs).where("outdegree > 1").groupBy("graph_id").agg(F.array_sort(F.collect_list("outdegree")).alias("d"))
    return big.select("graph_id", F.array_join(F.col("d").cast("array<string>"), ",").alias("degrees"))


def laplacian(arcs: DataFrame) -> DataFrame:
    """Out-Laplacian as (graph_id, i, j, value): D_out - A, loops cancel, zeros left out."""
    off = arcs.where("u <> v")
    cells = off.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("m")).alias("x")).unionByName(off.select("graph_id", F.col("u").alias("i"), F.col("u").alias("j"), F.col("m").alias("x")))
    return cells.groupBy("graph_id", "i", "j").agg(F.sum("x").alias("value")).where("value <> 0")


def line_digraph(arcs: DataFrame) -> DataFrame:
    """(graph_id, u, v, m): arcs become vertices "a>b"; m is the number of pairs of parallel copies."""
    a = arcs.select("graph_id", F.concat("u", F.lit(">"), "v").alias("u2"), F.col("v").alias("mid"), F.col("m").alias("m1"))
    b = arcs.select("graph_id", F.col("u").alias("mid"), F.concat("u", F.lit(">"), "v").alias("v2"), F.col("m").alias("m2"))
    return a.join(b, ["graph_id", "mid"]).select("graph_id", F.col("u2").alias("u"), F.col("v2").alias("v"), (F.col("m1") * F.col("m2")).alias("m"))


def complete_de_bruijn(spark, letters: int, k: int) -> DataFrame:
    """(graph_id, u, v, m): every word of k letters, as a number, and its ``letters`` continuations."""
    words = spark.range(letters**k).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(letters - 1))).alias("c"))
    return words.select(F.lit(0).cast("long").alias("graph_id"), F.col("u").cast("string").alias("u"), ((F.col("u") * letters + F.col("c")) % letters**k).cast("string").alias("v"), F.lit(1).cast("long").alias("m"))


# ---------------------------------------------------------------- components


#: Edges that a task joins before the rounds.
LOCAL = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A vertex of the component of each of n vertices, the same all over the component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if not (live := x != y).any():
            return root
        a, b, x, y = a[live], b[live], x[live], y[live]
        up = np.arange(n)
        up[np.maximum(x, y)] = np.minimum(x, y)  # of several hooks any one will do
        while (up != (above := up[up])).any():
            up = above
        root = up[root]


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components and vertices: each task makes stars of the edges that it reads, ``LOCAL`` at a time.

    Every vertex of a lot is a ``b`` once, with one vertex of its component as ``a``.
    """
    return edges.select("a", "b").mapInArrow(_stars_of, edges.select("a", "b").schema)


def _stars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        lot = pa.Table.from_batches(held)
        names = pa.concat_arrays([c for at in ("a", "b") for c in lot.column(at).chunks]).dictionary_encode(null_encoding="encode")
        a, b = np.asarray(names.indices).reshape(2, -1)
        known = np.asarray(names.dictionary.is_valid())
        live = known[a] & known[b]
        root = _roots(a[live], b[live], len(known))
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(root)), names.dictionary], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LOCAL:
            yield star()
            held.clear()
    if any(x.num_rows for x in held):
        yield star()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): weak components, named by their least node.

    Tasks first make stars of the edges that they read.  Each round hooks every component to the least one next to it and flattens
    the hooks by pointer jumping, so rounds grow with the logarithm of the
    longest chain; a hub only adds rows that a map-side minimum removes.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if isinstance(ends.schema["a"].dataType, (T.StringType, T.IntegralType)) and ends.schema["a"].dataType == ends.schema["b"].dataType:
        stars = scratch.save(_stars(ends), "stars")
        nodes, ends = stars.select(F.col("b").alias("node")).distinct(), stars.where("a <> b")
    else:
        nodes = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
        ends = scratch.save(ends.where("a <> b").distinct(), "edges-0")
    label = scratch.save(nodes.select("node", F.col("node").alias("component")), "label-0")
    step = 0
    while ends.limit(1).count():
        down = ends.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).groupBy("child").agg(F.min("parent").alias("parent"))
        forest, jump = scratch.save(down, f"forest-{step}-0"), 0
        while True:
            up = forest.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            moved = forest.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
            jump += 1
            moved = scratch.save(moved, f"forest-{step}-{jump}")
            forest = moved.select("child", "parent")
            if not moved.where("moved").limit(1).count():
                break
        step += 1
        rename = lambda df, c: df.join(forest.select(F.col("child").alias(c), F.col("parent").alias("_p")), c, "left").withColumn(c, F.coalesce("_p", c)).drop("_p")  # noqa: E731,B023
        label = scratch.save(rename(label, "component").select("node", "component"), f"label-{step}")
        ends = scratch.save(rename(rename(ends, "a"), "b").where("a <> b").select("a", "b").distinct(), f"edges-{step}")
        scratch.release()
    return label


def connected(arcs: DataFrame) -> DataFrame:
    """(graph_id, components): number of weak components of each graph."""
    named = arcs.select("graph_id", F.struct("graph_id", "u").alias("u"), F.struct("graph_id", F.col("v").alias("u")).alias("v"))
    found = components(named)
    return found.groupBy(F.col("node.graph_id").alias("graph_id")).agg(F.count_distinct("component").alias("components"))


def signed_balance(edges: DataFrame) -> DataFrame:
    """(graph_id, balanced) of signed graphs (graph_id, u, v, sign): no vertex meets its negative in the signed double cover."""
    side = lambda v, s: F.struct("graph_id", F.col(v).alias("x"), s.alias("s"))
    one = F.lit(1)
    lifted = edges.select(side("u", one).alias("u"), side("v", F.col("sign")).alias("v")).unionByName(edges.select(side("u", -one).alias("u"), side("v", -F.col("sign")).alias("v")))
    label = components(lifted).select(F.col("node.graph_id").alias("graph_id"), F.col("node.x").alias("x"), "component")
    sides = label.groupBy("graph_id", "x").agg(F.count_distinct("component").alias("c"))
    return sides.groupBy("graph_id").agg(F.bool_and(F.col("c") == 2).alias("balanced"))


def signed_quotient(contents: DataFrame) -> DataFrame:
    """Signed quotient of a double cover without fixed vertices: (graph_id, u, v, sign, m).

    A vertex orbit is named by its lexicographically smaller word; the sign of
    an arc is +1 where both of its ends are (or neither is) that word.
    """
    from strandweave.functions.sequences import reverse_complement

    t, h = F.col("tail"), F.col("head")
    rep = lambda w: F.least(w, reverse_complement(w))
    eps = lambda w: F.when(w <= reverse_complement(w), 1).otherwise(-1)
    half = contents.where("content <= partner")
    return half.select(F.col("seq_id").alias("graph_id"), rep(t).alias("u"), rep(h).alias("v"), (eps(t) * eps(h)).alias("sign"), "m")


# ---------------------------------------------------------------- contraction


def unitigs(arcs: DataFrame) -> DataFrame:
    """(graph_id, u, v, m): vertices of in- and out-degree one merged into the arcs through them.

    A graph that is a single cycle has no other vertex and gives no arcs.
    """
    scratch = Scratch(arcs.sparkSession, "unitigs", merge=True)
    arcs = scratch.save(arcs.select("graph_id", "u", "v", "m"), "arcs")
    one = degrees(arcs).where("indegree = 1 and outdegree = 1").select("graph_id", F.col("v").alias("x"))
    one = scratch.save(one, "inner")
    # where each inner vertex leads, skipping over inner vertices, by pointer doubling
    hop = arcs.join(one, (arcs.graph_id == one.graph_id) & (arcs.u == one.x)).select(arcs.graph_id, F.col("u").alias("x"), F.col("v").alias("to"))
    inner = one.select("graph_id", F.col("x").alias("to"), F.lit(True).alias("more"))
    hop = scratch.save(hop.join(inner, ["graph_id", "to"], "left").select("graph_id", "x", "to", F.coalesce("more", F.lit(False)).alias("more")), "hop-0")
    step, before = 0, None
    while True:
        open_ends = hop.where("more").count()
        if not open_ends or open_ends == before:  # only closed cycles are left
            break
        before = open_ends
        nxt = hop.select("graph_id", F.col("x").alias("to"), F.col("to").alias("to2"), F.col("more").alias("more2"))
        step += 1
        hop = scratch.save(hop.join(nxt, ["graph_id", "to"], "left").select("graph_id", "x", F.when(F.col("more"), F.col("to2")).otherwise(F.col("to")).alias("to"), F.when(F.col("more"), F.col("more2")).otherwise(F.lit(False)).alias("more")), f"hop-{step}")
    ends = hop.where("not more").select("graph_id", F.col("x").alias("v"), "to")
    outer = arcs.join(one.select("graph_id", F.col("x").alias("u")), ["graph_id", "u"], "left_anti")
    return outer.join(ends, ["graph_id", "v"], "left").select("graph_id", "u", F.coalesce("to", "v").alias("v"), "m").groupBy("graph_id", "u", "v").agg(F.sum("m").alias("m"))


def bundle_steps(arcs: DataFrame) -> DataFrame:
    """(graph_id, u, v, r): every out-arc of u goes to one other vertex v, and both have out-degree r > 1."""
    out = arcs.groupBy("graph_id", "u").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.sum("m").alias("r"))
    ends = out.where("v = w and u <> v and r > 1").select("graph_id", "u", "v", "r")
    deg = out.select("graph_id", F.col("u").alias("v"), F.col("r").alias("s"))
    return ends.join(deg, ["graph_id", "v"]).where("r = s").select("graph_id", "u", "v", "r")


def bundle_contract(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract maximal bundle chains of balanced multigraphs.

    Returns the skeleton arcs and the chains (graph_id, head, r, s): a chain of
    s vertices splits (Z/r)^(s-1) off the critical group, and its vertices
    become its least vertex.
    """
    scratch = Scratch(arcs.sparkSession, "bundles")
    steps = scratch.save(bundle_steps(arcs), "steps")
    end = lambda c: F.struct("graph_id", F.col(c).alias("x"))
    label = components(steps.select(end("u").alias("u"), end("v").alias("v"))).select(F.col("node.graph_id").alias("graph_id"), F.col("node.x").alias("x"), F.col("component.x").alias("head"))
    label = scratch.save(label, "label")
    degree = steps.select("graph_id", F.col("u").alias("x"), "r").unionByName(steps.select("graph_id", F.col("v").alias("x"), "r")).distinct()
    chains = label.join(degree, ["graph_id", "x"]).groupBy("graph_id", "head").agg(F.min("r").alias("r"), F.count("*").alias("s"))
    inside = steps.select("graph_id", "u", "v")
    rest = arcs.join(inside, ["graph_id", "u", "v"], "left_anti")
    # a chain that closes on itself keeps one bundle, as loops at its head
    for c in ("u", "v"):
        rest = rest.join(label.select("graph_id", F.col("x").alias(c), F.col("head").alias(f"_{c}")), ["graph_id", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rest.groupBy("graph_id", "u", "v").agg(F.sum("m").alias("m")), chains


def chord_crossings(walks: DataFrame, graph: str, symbol: str, pos: str) -> DataFrame:
    """(graph, a, b): pairs of symbols seen exactly twice whose occurrences interlace on the circle, a < b."""
    from strandweave.functions.sequences import chords_cross

    chords = walks.groupBy(graph, symbol).agg(F.count("*").alias("c"), F.min(pos).alias("p1"), F.max(pos).alias("p2")).where("c = 2")
    a = chords.select(graph, F.col(symbol).alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    b = chords.select(graph, F.col(symbol).alias("b"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    return a.join(b, graph).where(F.col("a") < F.col("b")).where(chords_cross("a1", "a2", "b1", "b2")).select(graph, "a", "b")


def path_counts(arcs: DataFrame, source: str) -> DataFrame:
    """(node, paths): number of directed paths from ``source`` in a DAG, parallel arcs distinct.

    Level by level until no path goes on; a path of more arcs than there are
    tails has met a cycle, which is an error.
    """
    scratch = Scratch(arcs.sparkSession, "paths")
    tails = arcs.select("u").distinct().count()
    front = scratch.save(arcs.sparkSession.createDataFrame([(source, 1)], "node string, n long"), "0")
    found, step = front, 0
    while front.limit(1).count():
        step += 1
        if step > tails + 1:
            raise ValueError("the arcs reachable from the source have a cycle")
        front = scratch.save(front.join(arcs, front.node == arcs.u).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("n") * F.col("m")).alias("n")), str(step))
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.sum("n").alias("paths"))


# ---------------------------------------------------------------- intervals and runs


def gap_clusters(rows: DataFrame, key: str, start: str, end: str, gap: int, strand: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of intervals of a key: a new one begins where the start lies more than ``gap`` beyond
    all ends so far, or the strand changes.  Adds ``cluster`` (from 0); intervals with equal ends are taken in the order of ``ties``."""
    w = Window.partitionBy(key).orderBy(start, end, *ties)
    if strand:
        rows = rows.withColumn("_turn", F.coalesce((F.lag(strand).over(w) != F.col(strand)).cast("int"), F.lit(0)))
        rows = rows.withColumn("_turns", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")
        inner = Window.partitionBy(key, "_turns").orderBy(start, end, *ties)
    else:
        rows, inner = rows.withColumn("_turns", F.lit(0)), w
    reach = F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0))
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cluster", F.sum("_new").over(whole) - 1).drop("_new", "_turns")


def overlapping(a: DataFrame, b: DataFrame, bin_width: int, on: str | None = None) -> DataFrame:
    """Pairs of closed integer intervals (a_id, a_lo, a_hi) and (b_id, b_lo, b_hi) that overlap, by a join on bins.

    Each pair is made once, in the bin of its first common point; the work
    grows with overlaps, not with the product of the sides.
    """
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width)))
    keys = [on, "bin"] if on else ["bin"]
    x, y = a.where("a_lo <= a_hi").withColumn("bin", cut("a_lo", "a_hi")), b.where("b_lo <= b_hi").withColumn("bin", cut("b_lo", "b_hi"))
    hit = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.floor(F.greatest("a_lo", "b_lo") / bin_width) == F.col("bin"))
    return x.join(y, keys).where(hit).drop("bin")


def run_blocks(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, first, last): maximal runs of consecutive positions."""
    w = Window.partitionBy(key).orderBy(pos)
    islands = rows.withColumn("_island", F.col(pos) - F.row_number().over(w))
    return islands.groupBy(key, "_island").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("_island")


def upper_median(values: DataFrame, key: str, value: str, shards: int = 64) -> DataFrame:
    """(key, n, median): the element of rank n div 2 (from 0) of the sorted values.

    Equal values are counted first.  Distinct values are then dealt into ranges
    between quantile sketches of each key; one pass over range totals finds the
    range that holds the median, and only that range is sorted.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    marks = values.where(F.col(value).isNotNull()).groupBy(key).agg(F.percentile_approx(value, [i / shards for i in range(1, shards)], 1000).alias("marks"), F.count("*").alias("n"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    marks = marks.withColumnRenamed(key, "_key")
    dealt = counted.join(marks, same).withColumn("range", F.size(F.filter("marks", lambda m: m < F.col(value)))).select(key, value, "c", "n", "range")
    totals = dealt.groupBy(key, "range").agg(F.sum("c").alias("t"), F.first("n").alias("n"))
    before = F.sum("t").over(Window.partitionBy(key).orderBy("range")) - F.col("t")
    place = totals.withColumn("before", before).where((F.col("before") <= F.expr("n div 2")) & (F.expr("n div 2") < F.col("before") + F.col("t")))
    place = place.select(F.col(key).alias("_key"), F.col("range").alias("_range"), "before")
    chosen = dealt.join(place, same & (F.col("range") == F.col("_range")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(key).orderBy(value))
    chosen = chosen.withColumn("upto", upto).where((F.expr("n div 2") < F.col("upto")) & (F.expr("n div 2") >= F.col("upto") - F.col("c")))
    return chosen.select(key, "n", F.col(value).alias("median"))


def detachments(arcs: DataFrame) -> DataFrame:
    """(graph_id, vertex, head, tail, u, v, m): the arcs that change where a vertex of three arcs in and out is split.

    ``arcs`` have text vertices.  For each vertex with three arcs in, three out
    and no loop, and each choice of one arc in (``head``, from 1) and one out
    (``tail``): the chosen arc in ends at a new vertex (the name and an
    apostrophe), from which the other two arcs out now leave, and an arc leads
    from the old vertex to the new one.  Both then have two arcs in and out.
    All other arcs of the graph stay; nothing else is copied.
    """
    scratch = Scratch(arcs.sparkSession, "detachments", merge=True)
    arcs = scratch.save(arcs.select("graph_id", "u", "v", "m"), "arcs")
    looped = arcs.where("u = v").select("graph_id", F.col("u").alias("vertex")).distinct()
    split = degrees(arcs).where("indegree = 3 and outdegree = 3").select("graph_id", F.col("v").alias("vertex")).join(looped, ["graph_id", "vertex"], "left_anti")
    split = scratch.save(split, "split")
    copies = arcs.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select("graph_id", "u", "v", "_c")
    number = lambda own, other: F.row_number().over(Window.partitionBy("graph_id", own).orderBy(other, "_c")).cast("int")
    choice = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    both = split.withColumn("head", choice).withColumn("tail", choice)
    new = F.concat("vertex", F.lit("'"))
    ins = copies.join(split, (copies.graph_id == split.graph_id) & (copies.v == split.vertex)).select(copies.graph_id, "u", "v", "_c").withColumn("_i", number("v", "u")).select("graph_id", F.col("v").alias("vertex"), F.col("u").alias("far"), "_i")
    outs = copies.join(split, (copies.graph_id == split.graph_id) & (copies.u == split.vertex)).select(copies.graph_id, "u", "v", "_c").withColumn("_i", number("u", "v")).select("graph_id", F.col("u").alias("vertex"), F.col("v").alias("far"), "_i")
    key = ["graph_id", "vertex", "head", "tail"]
    ends = both.join(ins, ["graph_id", "vertex"]).select(*key, F.col("far").alias("u"), F.when(F.col("_i") == F.col("head"), new).otherwise(F.col("vertex")).alias("v"))
    starts = both.join(outs, ["graph_id", "vertex"]).select(*key, F.when(F.col("_i") == F.col("tail"), F.col("vertex")).otherwise(new).alias("u"), F.col("far").alias("v"))
    middle = both.select(*key, F.col("vertex").alias("u"), new.alias("v"))
    return ends.unionByName(starts).unionByName(middle).groupBy(*key, "u", "v").agg(F.count("*").alias("m"))
