"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

They work on whole texts, half a megabyte at a time, so that a worker's memory
does not depend on the size of a batch (one very long text is one slice).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.session import small_batches

#: White space that separates words: space and the bytes 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE_BYTES = 1 << 19
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (public splitmix constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of rows of about ``most`` bytes."""
    data, offsets = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word ``[^\\x20\\x09-\\x0D]+``, and the number of words of each text."""
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends - starts, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, _U)
    bounds = np.cumsum(lengths) - lengths
    total = int(bounds[-1] + lengths[-1])
    at = np.arange(total)
    within = at - np.repeat(bounds, lengths)
    values = LOWER[data[within + np.repeat(starts, lengths)]].astype(_U) + _U(1)
    powers = np.empty(int(lengths.max()), _U)
    powers[0] = 1
    if len(powers) > 1:
        powers[1:] = np.cumprod(np.full(len(powers) - 1, 0x9DDFEA08EB382D69, _U))
    return mix64(np.add.reduceat(values * powers[within], bounds) ^ (lengths.astype(_U) << _U(40)))


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and the size of each set.

    A text of fewer than ``width`` words has one shingle, its whole sequence; a
    text without words has none.
    """
    factors = odd_constants(width, 77)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(max(0, len(hashes) - width + 1), _U)
    for j in range(width):
        grams += hashes[j : j + len(grams)] * factors[j]
    grams = mix64(grams)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        lo = bounds[i]
        if n >= width:
            own = np.unique(grams[lo : lo + n - width + 1])
        elif n:
            own = mix64((hashes[lo : lo + n] * factors[:n]).sum(dtype=_U, keepdims=True) + _U(0xA5A5 + n))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), sizes


def text_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, lengths, counts = words(data, offsets)
    return shingle_sets(word_hashes(data, starts, lengths), counts, width)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of a few megabytes; a worker gives freed memory back after each task."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own way
        pass
