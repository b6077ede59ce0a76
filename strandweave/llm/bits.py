"""A bit table of bounded size that tells which rows can belong to a set of keys.

Rows whose bit is not set are surely outside the set; the others (members and
a few false hits, about one in sixteen) go on to an exact join.  So a large
table meets a small set of keys without being shuffled, and what is broadcast
has at most ``MOST_BITS`` / 64 rows of two numbers, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import Scratch

#: Beyond it more rows go on to the exact join; none is lost.
MOST_BITS = 1 << 26
_AT, _WORD, _MASK = "_bit at_", "_bit word_", "_bit mask_"


class BitTable:
    """The keys of a saved table, hashed on its first columns, into a table of 64-bit words."""

    def __init__(self, scratch: Scratch, name: str, keys: DataFrame, most: int = MOST_BITS):
        self.bits = min(most, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
        at = F.pmod(F.xxhash64(*keys.columns), F.lit(self.bits)).alias("at")
        words = keys.select(at).groupBy(F.shiftright("at", 6).alias(_WORD)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias(_MASK))
        self.words = scratch.save(words.coalesce(1) if self.bits <= 1 << 20 else words, name)

    def mark(self, df: DataFrame, keys: list, column: str) -> DataFrame:
        """``df`` with a boolean column: false for rows whose ``keys`` are surely not in the set."""
        placed = df.withColumn(_AT, F.pmod(F.xxhash64(*keys), F.lit(self.bits)))
        joined = placed.join(F.broadcast(self.words), F.shiftright(F.col(f"`{_AT}`"), 6) == F.col(f"`{_WORD}`"), "left")
        hit = F.expr(f"coalesce((shiftright(`{_MASK}`, cast(`{_AT}` & 63 as int)) & 1L) = 1L, false)")
        return joined.withColumn(column, hit).drop(_AT, _WORD, _MASK)
