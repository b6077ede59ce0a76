"""Counts of lattice points by elimination along a frontier, with the states as rows of a table.

The arcs of a multigraph (graph_id, u, v, m) are taken one after the other; of
arc a, c_a of its m_a copies are chosen.  A state is what in-degree is ahead of
out-degree at each vertex so far, and the number of choices that lead to it.  A
vertex whose last arc has been taken must be balanced, which closes it.  One
level of all graphs together is one join with the arcs of that level and one
sum by (graph, state); no state is ever on the driver.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import Scratch

LOG = logging.getLogger(__name__)

#: The states of one graph meet its arcs in this many parts.
PARTS = 32


def arc_order(arcs: DataFrame) -> DataFrame:
    """(graph_id, level, a, b, m, closed): arcs in the order of elimination, ends as numbers from 0.

    Vertices with few different neighbours come first, and an arc is taken
    when the first of its ends comes; ``closed`` are the vertices of which it
    is the last arc.  An end with several arcs only meets them in its own graph.
    """
    arcs = arcs.groupBy("graph_id", "u", "v").agg(F.sum("m").alias("m")).where("m > 0").hint("merge")
    ends = arcs.select("graph_id", F.col("u").alias("x"), F.col("v").alias("y")).unionByName(arcs.select("graph_id", F.col("v").alias("x"), F.col("u").alias("y")))
    degree = ends.groupBy("graph_id", "x").agg(F.count_distinct("y").alias("d"))
    place = degree.select("graph_id", "x", (F.row_number().over(Window.partitionBy("graph_id").orderBy("d", "x")) - 1).alias("at")).hint("merge")
    at = lambda c, name: place.select("graph_id", F.col("x").alias(c), F.col("at").alias(name))
    numbered = arcs.join(at("u", "a"), ["graph_id", "u"]).join(at("v", "b"), ["graph_id", "v"])
    order = Window.partitionBy("graph_id").orderBy(F.least("a", "b"), F.greatest("a", "b"), "a")
    numbered = numbered.select("graph_id", F.row_number().over(order).alias("level"), "a", "b", "m")
    last = numbered.select("graph_id", "level", F.explode(F.array("a", "b")).alias("x")).groupBy("graph_id", "x").agg(F.max("level").alias("level"))
    closed = last.groupBy("graph_id", "level").agg(F.array_sort(F.collect_list("x")).alias("closed"))
    return numbered.join(closed.hint("merge"), ["graph_id", "level"], "left")


def balanced_choices(arcs: DataFrame) -> DataFrame:
    """(graph_id, choices, peak): how many sub-multigraphs are balanced, and the most states of a level.

    The empty choice and the whole of a balanced graph are among them.  Counts
    are decimals of 38 digits; one that does not fit is an error.
    """
    scratch = Scratch(arcs.sparkSession, "frontier", merge=True)
    ordered = scratch.save(arc_order(arcs), "order")
    levels = ordered.agg(F.max("level")).first()[0] or 0
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    big = lambda c: F.cast("decimal(38,0)", c) if isinstance(c, str) else c.cast("decimal(38,0)")
    width = ordered.groupBy("graph_id").agg((F.max(F.greatest("a", "b")) + 1).alias("w"))
    states = scratch.save(width.select("graph_id", F.expr("array_repeat(0L, w)").alias("state"), big(F.lit(1)).alias("n")), "level-0")
    peaks, done = [], []
    for level in range(1, levels + 1):
        now = ordered.where(F.col("level") == level).withColumn("part", parts)
        dealt = states.withColumn("part", F.pmod(F.xxhash64("state"), F.lit(PARTS)).cast("int"))
        met = dealt.join(now, ["graph_id", "part"], "left")
        done.append(met.where("level is null").select("graph_id", "n"))  # graphs without arcs left
        met = met.where("level is not null").withColumn("c", F.explode(F.expr("sequence(0L, m)")))
        moved = F.transform("state", lambda x, i: x + F.when(i == F.col("b"), F.col("c")).otherwise(0) - F.when(i == F.col("a"), F.col("c")).otherwise(0))
        met = met.select("graph_id", moved.alias("state"), "closed", "n")
        met = met.where(F.col("closed").isNull() | F.forall("closed", lambda x: F.element_at("state", (x + 1).cast("int")) == 0))
        states = scratch.save(met.groupBy("graph_id", "state").agg(big(F.sum("n")).alias("n")), f"level-{level}")
        peaks.append(states.groupBy("graph_id").agg(F.count("*").alias("s")))
        LOG.info("frontier: level %d of %d has %d states", level, levels, states.count())
    if not peaks:
        return width.select("graph_id", big(F.lit(1)).alias("choices"), F.lit(0).cast("long").alias("peak"))
    total, peak = states.select("graph_id", "n"), peaks[0]
    for d in done:
        total = total.unionByName(d)
    for p in peaks[1:]:
        peak = peak.unionByName(p)
    total = total.groupBy("graph_id").agg(big(F.sum("n")).alias("choices"))
    return total.join(peak.groupBy("graph_id").agg(F.max("s").alias("peak")).hint("merge"), "graph_id")
