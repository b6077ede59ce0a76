"""Paths and strong components of large directed graphs, as rounds of joins.

Arcs are rows (graph_id, u, v, ...).  A round is a written table, so lineage
stays short and a lost executor costs unfinished tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.graphs import degrees
from strandweave.session import Scratch

KEY = ["graph_id", "x"]


def _ranked(inner: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """List ranking of chains (graph_id, x, to), where ``to`` is no row of its own at the end of a chain.

    Gives (graph_id, x, last, rank), the last vertex of the chain and how far
    it is, and the rows of closed chains (graph_id, x, to, least) with the
    least vertex of their circle.  A round doubles the distance looked over.
    """
    own = inner.select("graph_id", F.col("x").alias("to"), F.lit(True).alias("_on"))
    step = inner.join(own, ["graph_id", "to"], "left").select(*KEY, "to", F.col("_on").isNotNull().alias("open"), F.lit(0).cast("long").alias("rank"), F.col("x").alias("last"), F.col("x").alias("least"))
    now, before, turn = scratch.save(step, f"{name}-0"), None, 0
    while True:
        left = now.where("open").agg(F.count("*"), F.sum(F.xxhash64(*KEY, "least").cast("decimal(38,0)"))).first()
        if not left[0] or left == before:  # every open chain is closed, and its least vertex is known to all of it
            break
        before, turn = left, turn + 1
        ahead = now.select("graph_id", F.col("x").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"), F.col("rank").alias("_rank"), F.col("last").alias("_last"), F.col("least").alias("_least"))
        both = now.where("open").join(ahead, ["graph_id", "to"])
        # one step on leads to the vertex ``to``, which has its own way from there
        moved = both.select(*KEY, F.col("_to").alias("to"), F.col("_open").alias("open"), (F.col("rank") + 1 + F.col("_rank")).alias("rank"), F.col("_last").alias("last"), F.least("least", "_least").alias("least"))
        now = scratch.save(now.where("not open").unionByName(moved), f"{name}-{turn}")
    closed = now.where("open").select(*KEY, "least").join(inner, KEY)
    return now.where("not open").select(*KEY, "last", "rank"), closed


def labelled_unitigs(arcs: DataFrame, cycles: bool = False) -> DataFrame:
    """(graph_id, u, v, m, arcs, label): maximal paths whose inner vertices have one arc in and one out.

    ``arcs`` is (graph_id, u, v, m, label); parallel arcs of different labels
    are rows of their own.  The labels of a path are joined in its order, and
    ``arcs`` counts them.  A path is spelled by one group, at the very end.
    With ``cycles``, circles of such vertices alone are given too, cut at their
    least vertex; a graph that is one circle has no paths otherwise.
    """
    scratch = Scratch(arcs.sparkSession, "labelled-unitigs", merge=True)
    arcs = scratch.save(arcs.select("graph_id", "u", "v", "m", "label"), "arcs")
    one = degrees(arcs).where("indegree = 1 and outdegree = 1").select("graph_id", F.col("v").alias("x"))
    one = scratch.save(one, "inner")
    hop = scratch.save(arcs.join(one.withColumnRenamed("x", "u"), ["graph_id", "u"], "left_semi").select("graph_id", F.col("u").alias("x"), F.col("v").alias("to")), "hop")
    ranked, closed = _ranked(hop, scratch, "rank")
    cuts = None
    if cycles:
        cuts = scratch.save(closed.where("x = least").select(*KEY), "cuts")
        opened = scratch.save(closed.join(cuts, KEY, "left_anti").select(*KEY, "to"), "opened")
        ranked = ranked.unionByName(_ranked(opened, scratch, "circle")[0])
    ranked = scratch.save(ranked, "ranked")
    ends = one if cuts is None else one.join(cuts, KEY, "left_anti")
    ends = ends.select("graph_id", F.col("x").alias("u"), F.lit(True).alias("_inner"))
    outer = arcs.join(ends, ["graph_id", "u"], "left_anti")
    # an arc that enters a chain begins its path; the arcs out of the chain follow by falling rank
    entry = ranked.select("graph_id", F.col("x").alias("v"), "last", "rank")
    first = outer.join(entry, ["graph_id", "v"], "left")
    single = first.where("last is null").select("graph_id", "u", "v", "m", F.lit(1).cast("long").alias("arcs"), "label")
    begun = first.where("last is not null").select("graph_id", "last", "u", "m", (F.col("rank") + 1).alias("rank"), "label", F.col("v").alias("to"))
    inside = ranked.join(arcs.select("graph_id", F.col("u").alias("x"), F.col("v").alias("to"), "label"), KEY).select("graph_id", "last", F.lit(None).cast(arcs.schema["u"].dataType).alias("u"), F.lit(None).cast(arcs.schema["m"].dataType).alias("m"), "rank", "label", "to")
    spelled = begun.unionByName(inside).groupBy("graph_id", "last").agg(
        F.max("u").alias("u"), F.min_by("to", "rank").alias("v"), F.max("m").alias("m"), F.count("*").alias("arcs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "label"))), lambda x: x["label"]), "").alias("label"))
    return single.unionByName(spelled.where("u is not null").select("graph_id", "u", "v", "m", "arcs", "label"))


def strong_components(arcs: DataFrame, trims: int = 3) -> DataFrame:
    """(graph_id, v, component): strong components, named by their least vertex.

    Vertices without an arc in or out among what is left are their own
    component and leave first.  Then every vertex takes the least vertex that
    reaches it as its colour; a component that holds its colour's vertex is
    what reaches that vertex inside the colour.  Arcs between colours join no
    component and are dropped.  Colours spread along changed vertices only.
    """
    scratch = Scratch(arcs.sparkSession, "strong", merge=True)
    left = scratch.save(arcs.where("u <> v").select("graph_id", "u", "v").distinct(), "arcs-0")
    ends = arcs.select("graph_id", F.col("u").alias("x")).unionByName(arcs.select("graph_id", F.col("v").alias("x"))).distinct()
    nodes, turn = scratch.save(ends, "nodes-0"), 0
    done = []
    while nodes.limit(1).count():
        turn += 1
        for trim in range(trims):
            core = nodes.join(left.select("graph_id", F.col("u").alias("x")).distinct(), KEY, "left_semi").join(left.select("graph_id", F.col("v").alias("x")).distinct(), KEY, "left_semi")
            core = scratch.save(core, f"core-{turn}-{trim}")
            alone = scratch.save(nodes.join(core, KEY, "left_anti").select(*KEY, F.col("x").alias("component")), f"alone-{turn}-{trim}")
            if not alone.limit(1).count():
                break
            done.append(alone)
            kept = lambda c: core.withColumnRenamed("x", c)  # noqa: E731,B023
            nodes, left = core, scratch.save(left.join(kept("u"), ["graph_id", "u"], "left_semi").join(kept("v"), ["graph_id", "v"], "left_semi"), f"trimmed-{turn}-{trim}")
        # forward: the least vertex that reaches each vertex
        colour = nodes.withColumn("c", F.col("x"))
        colour = _spread(colour, colour, left, scratch, f"colour-{turn}")
        # backward inside a colour, from the vertex that names it
        at = lambda c, name: colour.select("graph_id", F.col("x").alias(c), F.col("c").alias(name))  # noqa: E731,B023
        inside = left.join(at("u", "c"), ["graph_id", "u"]).join(at("v", "_c"), ["graph_id", "v"]).where("c = _c")
        inside = scratch.save(inside.select("graph_id", "u", "v", "c"), f"inside-{turn}")
        roots = colour.where("x = c")
        back = inside.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))
        found = _spread(roots, roots, back, scratch, f"found-{turn}")
        done.append(found.select(*KEY, F.col("c").alias("component")))
        nodes = scratch.save(nodes.join(found, KEY, "left_anti"), f"nodes-{turn}")
        gone = lambda c: found.select("graph_id", F.col("x").alias(c))  # noqa: E731,B023
        left = scratch.save(inside.join(gone("u"), ["graph_id", "u"], "left_anti").join(gone("v"), ["graph_id", "v"], "left_anti").select("graph_id", "u", "v"), f"arcs-{turn}")
        scratch.release()
    if not done:
        return nodes.select("graph_id", F.col("x").alias("v"), F.col("x").alias("component"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("graph_id", F.col("x").alias("v"), "component")


def _spread(known: DataFrame, changed: DataFrame, arcs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Least colour that reaches each vertex along arcs; vertices without one get a row when one reaches them."""
    turn = 0
    while True:
        offers = changed.join(arcs.withColumnRenamed("u", "x"), KEY).groupBy("graph_id", F.col("v").alias("x")).agg(F.min("c").alias("_c"))
        news = offers.join(known, KEY, "left").where("c is null or _c < c").select(*KEY, F.col("_c").alias("c"))
        changed = scratch.save(news, f"{name}-news-{turn}")
        if not changed.limit(1).count():
            return known
        known = scratch.save(known.join(changed.select(*KEY, F.col("c").alias("_c")), KEY, "full").select(*KEY, F.coalesce("_c", "c").alias("c")), f"{name}-{turn}")
        turn += 1
