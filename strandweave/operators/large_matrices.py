"""Ranks of sparse matrices that are tables (i, j, value): elimination in rounds over the whole cluster.

Rows (x, -x), such as those of a graph's incidence matrix, are eliminated first
and all together: their pivots are a spanning forest (``_contracted``).

A round chooses many pivots at once.  Every row offers its entry in the
emptiest of its columns, every column takes the offer of the emptiest row, and
of two pivots that meet (one has an entry in the other's column) the one that
would fill in more gives way.  The pivots that are left do not meet, so their
block is diagonal and one join and one sum make the Schur complement of all of
them.  No row is ever gathered; a column or row of many entries is chosen last.

Modulo a prime every entry may be a pivot.  Once at most ``CORE`` columns are
left, the rows are dealt out in lots that are reduced to at most ``CORE`` rows
each, until one lot is left.  The result is exact; nothing is random but the
order of ties.

Over the integers only entries 1 and -1 are pivots; what has none of them is
left over.  Sums that leave 63 bits are an error (ANSI arithmetic).

Rounds are few as long as the matrix stays sparse.  A dense core wider than
``CORE`` takes a round for each pivot.  Each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.graphs import components
from strandweave.session import Scratch

#: The default modulus; products of two residues stay below 2**62.
PRIME = 2**31 - 1
#: Columns of a core that is finished in tasks, and rows of one lot of it.
CORE, LOT = 256, 4096


def echelon(a: np.ndarray, p: int) -> np.ndarray:
    """A basis of the row space modulo p, in echelon form."""
    a, done = a % p, 0
    for j in range(a.shape[1]):
        hit = np.flatnonzero(a[done:, j])
        if not len(hit):
            continue
        a[[done, done + hit[0]]] = a[[done + hit[0], done]]
        a[done] = a[done] * pow(int(a[done, j]), -1, p) % p
        below = done + 1 + np.flatnonzero(a[done + 1 :, j])
        a[below] = (a[below] - a[below, j][:, None] * a[done]) % p
        done += 1
    return a[:done]


def _inverse(value: Column, p: int | None) -> Column:
    if p is None:
        return value  # a unit is its own inverse

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: pow(int(x), -1, p)).astype("int64")

    return F.pandas_udf(run, "long")(value)


def _reduced(value: Column, p: int | None) -> Column:
    return value if p is None else F.pmod(value, F.lit(p))


def _pivots(entries: DataFrame, p: int | None, step: int) -> DataFrame:
    """(i, j, value, rank of the pivot): one for each row and column that agree, before those that meet give way."""
    rows, columns = entries.groupBy("i").agg(F.count("*").alias("_r")), entries.groupBy("j").agg(F.count("*").alias("_c"))
    units = entries if p else entries.where(F.abs("value") == 1)
    tie = F.xxhash64("i", "j", F.lit(step))
    offers = units.join(columns, "j").groupBy("i").agg(F.min(F.struct("_c", tie.alias("t"), "j", "value")).alias("o"))
    offers = offers.join(rows, "i").select("i", F.col("o.j").alias("j"), F.col("o.value").alias("value"), "_r", F.col("o._c").alias("_c"), F.col("o.t").alias("t"))
    taken = offers.groupBy("j").agg(F.min(F.struct("_r", "t", "i", "value", "_c")).alias("o"))
    cost = (F.col("o._r") - 1) * (F.col("o._c") - 1)
    return taken.select(F.col("o.i").alias("i"), "j", F.col("o.value").alias("value"), F.struct(cost.alias("cost"), F.col("o.t").alias("t"), F.col("o.i").alias("i")).alias("order"))


def _round(entries: DataFrame, p: int | None, scratch: Scratch, step: int) -> tuple[int, DataFrame]:
    pairs = scratch.save(_pivots(entries, p, step), f"pairs-{step}")
    met = entries.join(pairs.select("i", F.col("order").alias("_a")), "i").join(pairs.select("j", F.col("order").alias("_b")), "j").where("_a <> _b")
    loses = met.select(F.explode(F.array(F.greatest("_a", "_b"))).alias("order")).distinct()
    pivots = pairs.join(loses, "order", "left_anti").select("i", "j", _inverse(F.col("value"), p).alias("inverse"))
    pivots = scratch.save(pivots, f"pivots-{step}")
    here = pivots.select("i", F.col("j").alias("_pj"), "inverse")
    marked = entries.join(here, "i", "left").join(pivots.select("j", F.lit(True).alias("_in")), "j", "left")
    marked = scratch.save(marked, f"marked-{step}")
    above = marked.where("_pj is not null and j <> _pj").select("_pj", "j", _reduced(F.col("value") * F.col("inverse"), p).alias("_y"))
    aside = marked.where("_pj is null and _in").select("i", F.col("j").alias("_pj"), F.col("value").alias("_x"))
    change = aside.join(above, "_pj").select("i", "j", _reduced(-(F.col("_x") * F.col("_y")), p).alias("value"))
    rest = marked.where("_pj is null and _in is null").select("i", "j", "value")
    left = rest.unionByName(change).groupBy("i", "j").agg(_reduced(F.sum("value"), p).alias("value")).where("value <> 0")
    return pivots.count(), scratch.save(left, f"entries-{step}")


def _prepared(entries: DataFrame, p: int | None) -> DataFrame:
    cells = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _reduced(F.col("value").cast("long"), p).alias("value")).repartition("i")
    return cells.groupBy("i", "j").agg(_reduced(F.sum("value"), p).alias("value")).where("value <> 0")


def _contracted(entries: DataFrame, p: int | None, scratch: Scratch) -> tuple[int, DataFrame]:
    """(pivots, entries that are left) after all rows (x, -x) of a unit x have been eliminated at once.

    Such a row makes two columns equal.  A spanning forest of these rows gives
    its pivots, every other one of them becomes zero, and in all other rows
    the columns of a component add up at its least column.
    """
    whole = F.sum("value") if p is None else F.pmod(F.sum("value"), F.lit(p))
    pair = (F.count("*") == 2) & (whole == 0)
    if p is None:
        pair &= F.max(F.abs("value")) == 1
    rows = scratch.save(entries.groupBy("i").agg(F.min("j").alias("a"), F.max("j").alias("b"), pair.alias("pair")), "rows")
    found = components(rows.where("pair").select("a", "b"), "a", "b")
    done = found.where("node <> component").count()
    others = rows.where("not pair").select("i")
    if not others.limit(1).count():
        return done, scratch.save(entries.limit(0), "entries")
    left = entries.join(others, "i", "left_semi").join(found.withColumnRenamed("node", "j"), "j", "left").groupBy("i", F.coalesce("component", "j").alias("j")).agg(_reduced(F.sum("value"), p).alias("value"))
    return done, scratch.save(left.where("value <> 0"), "entries")


def _core_rank(entries: DataFrame, p: int, scratch: Scratch) -> int:
    names = sorted(r["j"] for r in entries.select("j").distinct().collect())  # at most CORE

    def reduce(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        at, lot = cells["i"].factorize()[0], key[0]
        a = np.zeros((at.max() + 1, len(names)), np.int64)
        a[at, np.searchsorted(names, cells["j"])] = cells["value"]
        a = echelon(a, p)
        i, j = np.nonzero(a)
        return pd.DataFrame({"i": lot * CORE + i, "j": np.array(names, np.int64)[j], "value": a[i, j]})

    step = 0
    while True:
        rows = entries.select("i").distinct().count()
        lots = -(-rows // LOT)
        entries = entries.withColumn("lot", F.pmod(F.xxhash64("i"), F.lit(max(lots, 1)))).groupBy("lot").applyInPandas(reduce, "i long, j long, value long")
        step += 1
        entries = scratch.save(entries, f"core-{step}")
        if lots <= 1:
            return entries.select("i").distinct().count()


def rank(entries: DataFrame, p: int = PRIME) -> int:
    """Rank modulo the prime p (below 2**31) of the matrix with these entries; equal places are added up."""
    if not 2 <= p < 2**31:
        raise ValueError("the modulus must be a prime below 2**31")
    scratch, step = Scratch(entries.sparkSession, "rank"), 0
    done, left = _contracted(_prepared(entries, p), p, scratch)
    while left.select("j").distinct().limit(CORE + 1).count() > CORE:
        n, left = _round(left, p, scratch, step)
        done, step = done + n, step + 1
    return done + _core_rank(left, p, scratch)


def unit_pivots(entries: DataFrame) -> tuple[int, DataFrame]:
    """(number of pivots 1 and -1, entries that are left): exact elimination over the integers.

    Nothing left shows that the matrix has only 1 as an elementary divisor, so
    that its cokernel is free.
    """
    scratch, step = Scratch(entries.sparkSession, "unit-pivots"), 0
    done, left = _contracted(_prepared(entries, None), None, scratch)
    while left.where("abs(value) = 1").limit(1).count():
        n, left = _round(left, None, scratch, step)
        done, step = done + n, step + 1
    return done, left


def nullity(entries: DataFrame, columns: int, p: int = PRIME) -> int:
    """Dimension of the kernel modulo p of a matrix with this number of columns (empty ones too)."""
    return columns - rank(entries, p)
