"""Pairs and triples of rows whose whole-number vectors add up to a target.

Rows with equal vectors are one class with a count, so equal vectors are never
paired row by row.  Only vectors within the box of the target can take part;
there are at most prod(t + 1) of them, however many rows there are.  The last
member of a pair or triple is found by an equi-join on what is missing.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classes(rows: DataFrame, target: list[int], key: str = "id", vector: str = "p") -> DataFrame:
    """(p, n, first): vectors without a negative entry or one above the target, their rows and the least key."""
    inside = F.forall(F.arrays_zip(F.col(vector).alias("x"), F.array(*map(F.lit, target)).alias("t")), lambda z: (z["x"] >= 0) & (z["x"] <= z["t"]))
    fit = rows.where((F.size(vector) == len(target)) & F.coalesce(inside, F.lit(False)))
    return fit.groupBy(F.col(vector).cast("array<bigint>").alias("p")).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def _less(whole, part):
    return F.zip_with(whole, part, lambda x, y: x - y)


def complement_classes(rows: DataFrame, target: list[int], members: int, key: str = "id", vector: str = "p") -> DataFrame:
    """(vectors, firsts, ways): classes of two or three vectors, in order, that add up to the target.

    ``ways`` is the number of sets of different rows, ``firsts`` the least key
    of each vector.  A vector may come twice or three times, by different rows.
    """
    if members not in (2, 3) or any(t < 0 for t in target):
        raise ValueError("two or three members, and a target without negative entries")
    if prod(t + 1 for t in target) > 10**6:
        raise ValueError("the box of the target is too large")
    found = classes(rows, target, key, vector)
    goal = F.array(*(F.lit(t).cast("bigint") for t in target))
    one = found.select(F.col("p").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa"), _less(goal, F.col("p")).alias("rest"))
    if members == 2:
        other = found.select(F.col("p").alias("rest"), F.col("n").alias("nb"), F.col("first").alias("fb"))
        met = one.join(other, "rest").where("a <= rest")
        ways = F.when(F.col("a") == F.col("rest"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
        return met.select(F.array("a", "rest").alias("vectors"), F.array("fa", "fb").alias("firsts"), ways.cast("bigint").alias("ways")).where("ways > 0")
    # the second vector by its first entry, which what is missing bounds
    second = found.select(F.col("p")[0].alias("x"), F.col("p").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"))
    pairs = one.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rest")[0]))).join(second, "x").where("a <= b")
    pairs = pairs.withColumn("rest", _less(F.col("rest"), F.col("b"))).where("b <= rest and forall(rest, z -> z >= 0)")
    third = found.select(F.col("p").alias("rest"), F.col("n").alias("nc"), F.col("first").alias("fc"))
    met = pairs.join(third, "rest")
    a, b, c, na, nb, nc = (F.col(x) for x in ("a", "b", "rest", "na", "nb", "nc"))
    ways = (
        F.when((a == b) & (b == c), na * (na - 1) * (na - 2) / 6)
        .when(a == b, na * (na - 1) / 2 * nc)
        .when(b == c, na * (nb * (nb - 1) / 2))
        .otherwise(na * nb * nc)
    )
    return met.select(F.array("a", "b", "rest").alias("vectors"), F.array("fa", "fb", "fc").alias("firsts"), F.round(ways).cast("bigint").alias("ways")).where("ways > 0")
