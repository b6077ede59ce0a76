"""Held-out split and the bounded sample that the classifiers of this subpackage learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id"):
    """True for documents that no model learns from: fold 0."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sample_of(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of the training folds, those with the smallest hash of their id.

    Only ids and labels travel; the texts of the chosen rows are read by the caller.
    """
    usable = rows.where(F.col("doc_id").isNotNull() & (fold() != 0))
    return usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
