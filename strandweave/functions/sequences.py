"""Column expressions on sequences; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET, COMPLEMENT = "ACGT", "TGCA"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c) -> Column:
    """A, C, G, T exchanged and the word reversed; other letters stay."""
    return F.reverse(F.translate(col(c), ALPHABET, COMPLEMENT))


def pseudo_dna(c) -> Column:
    """Letters a-z of a text mapped onto A, C, G, T in turn; everything else is dropped."""
    letters = F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^a-zA-Z]", ""))
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


_DNA = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ACGTACGTACGTACGTACGTACGTAC" * 2)
_OTHER = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def pseudo_dna_of(text: str | None) -> str:
    """The same in Python, in one pass over the bytes."""
    return (text or "").encode().translate(_DNA, _OTHER).decode()


def least_rotation(c) -> Column:
    """Lexicographically least rotation of a (short) cyclic word; an empty word is its own."""
    s = col(c)
    n = F.length(s)
    rotations = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(s, i, n), F.substring(s, F.lit(1), i - 1)))
    return F.array_min(rotations)


def spell(contents, k: int) -> Column:
    """The cyclic word that a closed walk of arc contents spells: each content without its last k letters."""
    return F.array_join(F.transform(col(contents), lambda a: F.substring(a, F.lit(1), F.length(a) - k)), "")


def differing_positions(a, b) -> Column:
    """Number of positions, up to the shorter length, at which two words differ."""
    a, b = F.split(col(a), ""), F.split(col(b), "")
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(False)).cast("int")), lambda z: z == 1)).cast("long")


def log10_factorial(n) -> Column:
    """log10(n!) as a sum of logarithms (n! itself is NULL beyond 20)."""
    n = col(n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), F.lit(0.0), lambda a, x: a + F.log10(x)))


def chords_cross(a1, a2, b1, b2) -> Column:
    """Whether the chords (a1, a2) and (b1, b2) of a circle interlace."""
    inside = lambda x: (col(a1) < col(x)) & (col(x) < col(a2))
    return inside(b1) != inside(b2)


def permutation_sign(p) -> Column:
    """+1 or -1 by the parity of inversions of an array without repeats."""
    p = col(p)
    inversions = F.aggregate(
        F.transform(p, lambda x, i: F.size(F.filter(F.slice(p, F.lit(1), i), lambda y: y > x))), F.lit(0), lambda a, x: a + x
    )
    return F.when(inversions % 2 == 0, 1).otherwise(-1)


def is_quotient(parent, child) -> Column:
    """Whether the abelian group with exponents ``child`` (of one prime) is a quotient of ``parent``: sorted exponents dominate."""
    p, q = F.array_sort(col(parent)), F.array_sort(col(child))
    longest = F.greatest(F.size(p), F.size(q))
    down = lambda a: F.reverse(F.concat(F.array_repeat(F.lit(0).cast("long"), longest - F.size(a)), a.cast("array<long>")))
    return F.forall(F.zip_with(down(p), down(q), lambda x, y: y <= x), lambda ok: ok)


def register(spark) -> None:
    """SQL names of the scalar functions that SQL text needs."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sw_rc(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sw_least_rotation(s STRING) RETURNS STRING RETURN array_min(transform(sequence(1, greatest(length(s), 1)), i -> concat(substr(s, i), substr(s, 1, i - 1))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sw_kmers(s STRING, k INT) RETURNS ARRAY<STRING> RETURN CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substr(s, i, k)) ELSE array() END")
