"""The nerve of a pool of strains as tables: intersection components, faces, homology.

A pool is two tables: vertices (v, strains) and arcs (u, v, strains), where
``strains`` is the array of the strains that have it.  A cell is a component
of the graph that all strains of a set of one, two or three have in common,
named by the set and its least vertex; a face of it is the component of the
smaller set that it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.operators import graphs, large_matrices
from strandweave.session import Scratch


def subsets(strains: str, most: int = 3) -> Column:
    """All sets of one to ``most`` (at most three) different strains of an array, each in order."""
    s = F.array_sort(F.array_distinct(strains))
    after = lambda i: F.slice(s, i, F.size(s))
    one = F.transform(s, lambda x: F.array(x))
    two = F.flatten(F.transform(s, lambda x, i: F.transform(after(i + 2), lambda y: F.array(x, y))))
    three = F.flatten(F.flatten(F.transform(s, lambda x, i: F.transform(after(i + 2), lambda y, j: F.transform(after(i + j + 3), lambda z: F.array(x, y, z))))))
    return F.concat(*[one, two, three][:most])


def gathered(rows: DataFrame, strain: str, *keys: str) -> DataFrame:
    """(keys, strains): the strains of the rows that have the same keys.

    Up to 63 different strains travel as bits of a number, which a task can
    sum up by hashing; more are collected.
    """
    few = [x[0] for x in rows.select(strain).where(F.col(strain).isNotNull()).distinct().limit(64).collect()]
    if len(few) > 63:
        return rows.groupBy(*keys).agg(F.collect_set(strain).alias("strains"))
    named = [(F.lit(1 << i), F.lit(x)) for i, x in enumerate(sorted(few))]
    bit = F.coalesce(*(F.when(F.col(strain) == x, b) for b, x in named), F.lit(0).cast("long")).cast("long")
    held = F.array_compact(F.array(*(F.when(F.col("_bits").bitwiseAND(b) != 0, x) for b, x in named)))
    return rows.select(*keys, bit.alias("_bit")).groupBy(*keys).agg(F.bit_or("_bit").alias("_bits")).select(*keys, held.alias("strains"))


def cells(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(sigma, v, cell): for each set of strains and vertex that all of them have, the least vertex of its component."""
    scratch = Scratch(vertices.sparkSession, "nerve-cells")
    arcs, vertices = scratch.save(arcs.select("u", "v", "strains"), "arcs"), scratch.save(vertices.select("v", "strains"), "vertices")
    # sets of one to three are made once for each different array of strains
    sigmas = arcs.select("strains").union(vertices.select("strains")).distinct()
    sigmas = scratch.save(sigmas.select("strains", F.explode(subsets("strains")).alias("sigma")), "sigmas")
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((arcs, "u"), (arcs, "v"), (vertices, "v"))):
        return _cells_of_structs(vertices.join(sigmas, "strains"), arcs.join(sigmas, "strains"))
    # the set's number and the vertex make one number; of the vertices of a set their order stays
    sets = sigmas.select("sigma").distinct().rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    sets = scratch.save(vertices.sparkSession.createDataFrame(sets, T.StructType([T.StructField("s", T.LongType()), sigmas.schema["sigma"]])), "sets")
    ends = arcs.agg(F.least(F.min("u"), F.min("v")).alias("low"), F.greatest(F.max("u"), F.max("v")).alias("high")).union(vertices.agg(F.min("v"), F.max("v")))
    low, high, n = ends.agg(F.min("low"), F.max("high")).join(sets.agg(F.count("*"))).first()
    if low is None or (high - low + 1) * n >= 2**63:
        return _cells_of_structs(vertices.join(sigmas, "strains"), arcs.join(sigmas, "strains"))
    wide = high - low + 1
    node = lambda v: F.col("s") * wide + (F.col(v).cast("long") - low)
    numbers = scratch.save(sigmas.join(sets, "sigma").select("strains", "s"), "numbers")
    points, sides = (df.join(numbers, "strains") for df in (vertices, arcs))
    touched = graphs.components(sides.select(node("u").alias("a"), node("v").alias("b")), "a", "b")
    # a vertex that no arc touches is its own component
    every = points.select(node("v").alias("node")).select("node", F.col("node").alias("component")).union(touched.select("node", "component"))
    found = every.groupBy("node").agg(F.min("component").alias("component"))
    place = lambda c: (F.col(c) % wide + low).cast(vertices.schema["v"].dataType)
    return found.withColumn("s", F.expr(f"node div {wide}")).join(sets, "s").select("sigma", place("node").alias("v"), place("component").alias("cell"))


def _cells_of_structs(points: DataFrame, sides: DataFrame) -> DataFrame:
    """The cells where sets and vertices do not fit into one number."""
    node = lambda v: F.struct("sigma", F.col(v).alias("v"))
    loops = points.select(node("v").alias("a"), node("v").alias("b"))
    found = graphs.components(loops.unionByName(sides.select(node("u").alias("a"), node("v").alias("b"))), "a", "b")
    return found.select("node.sigma", "node.v", F.col("component.v").alias("cell"))


def component_counts(found: DataFrame) -> DataFrame:
    """(sigma, vertices, components) of the cells."""
    return found.groupBy("sigma").agg(F.count("*").alias("vertices"), F.count_if(F.col("v") == F.col("cell")).alias("components"))


def boundary(found: DataFrame, size: int) -> DataFrame:
    """(row, column, value): the boundary of the cells of ``size`` strains; both ends are (sigma, cell)."""
    tops = found.where((F.size("sigma") == size) & (F.col("v") == F.col("cell"))).select("sigma", "cell")
    drop = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.filter("sigma", lambda _, i: i != d))).alias("at", "face")
    faces = tops.select("sigma", "cell", drop)
    below = found.where(F.size("sigma") == size - 1).select(F.col("sigma").alias("face"), F.col("v").alias("cell"), F.col("cell").alias("under"))
    hit = faces.join(below, ["face", "cell"])
    return hit.select(F.struct("face", F.col("under").alias("cell")).alias("row"), F.struct("sigma", "cell").alias("column"), F.when(F.col("at") % 2 == 0, 1).otherwise(-1).cast("long").alias("value"))


def _numbered(named: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The same matrix with numbers for its rows and columns."""
    named = scratch.save(named, name)
    number = lambda c: scratch.save(named.select(c).distinct().withColumn(f"_{c}", F.monotonically_increasing_id()), f"{name}-{c}")
    rows, columns = number("row"), number("column")
    return named.join(rows, "row").join(columns, "column").select(F.col("_row").alias("i"), F.col("_column").alias("j"), "value")


def homology(vertices: DataFrame, arcs: DataFrame, primes: tuple[int, ...] = ()) -> dict:
    """Number of cells by size of their sets, ranks of both boundaries, and the rank of H_1.

    ``free`` says that the second boundary was eliminated by unit pivots
    alone, so H_1 has no torsion; else ``primes`` gives for each prime asked
    for the dimension of H_1 modulo it, whose excess over the rank is torsion.
    """
    scratch = Scratch(vertices.sparkSession, "nerve")
    found = scratch.save(cells(vertices, arcs), "cells")
    counted = {r["n"]: r["count"] for r in found.where("v = cell").groupBy(F.size("sigma").alias("n")).count().collect()}
    sizes = [counted.get(n, 0) for n in (1, 2, 3)]
    one, two = (scratch.save(_numbered(boundary(found, n), scratch, f"named-{n}"), f"boundary-{n}") for n in (2, 3))
    rank_one = large_matrices.rank(one)
    units, left = large_matrices.unit_pivots(two)
    rank_two = units + large_matrices.rank(left)
    free = not left.limit(1).count()
    dims = {p: sizes[1] - rank_one - rank_two if free else sizes[1] - large_matrices.rank(one, p) - units - large_matrices.rank(left, p) for p in primes}
    return {"cells": sizes, "ranks": [rank_one, rank_two], "rank": sizes[1] - rank_one - rank_two, "free": free, "primes": dims}
