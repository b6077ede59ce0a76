"""Tables of vectors, and the two searches over them (operators 7 and 9).

Both searches take a stated set of query rows against all rows.  Rows are
stored once as blocks of bounded size: ids, vectors and what the method
precomputes (distances to pivots; packed codes with their correction scalars).
They are never shuffled.  The queries go out in chunks of bounded size, a chunk
to all tasks; a task holds its rows' blocks against the chunk one after the
other and keeps the ``k`` best rows of each query, so what is shuffled grows
with queries times tasks, not with rows or pairs.

Rows take no part where vec_id or the vector is null, or a component is null
or not finite (for cosine: also where all components are 0).  Finite vectors of
any size take part: for cosine each is first scaled by a power of two, which
changes no cosine and keeps its norm finite.  Vectors of
different lengths never meet.  Rows that repeat a vec_id are rows of their
own; a query skips every row that has its own vec_id.  Equal scores go to the
smaller vec_id.  An empty table, or no query, gives no rows.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.session import Scratch

BLOCK, QUERY_BLOCK = 2048, 512
#: Components of all queries that one broadcast holds (in expectation; blocks are dealt out by hash).
CHUNK = 1 << 22
_BLOCK = "dim int, block long, n int, ids binary, vectors binary, made array<binary>"


def _usable(batch: pa.RecordBatch, nonzero: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (ids, matrix) of the rows that take part."""
    found: dict[int, list] = {}
    ids = batch.column(0)
    lists = batch.column(1).cast(pa.list_(pa.float64()))
    offsets = np.asarray(lists.offsets)
    values = lists.values
    gaps = np.asarray(values.is_null())
    flat = np.asarray(values.fill_null(np.nan), float)
    null = np.asarray(lists.is_null()) | np.asarray(ids.is_null())
    keys = np.asarray(ids.fill_null(0), np.int64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat) | gaps)])
    bad = null | (wrong[offsets[1:]] > wrong[offsets[:-1]])
    for dim in np.unique(np.diff(offsets)):
        rows = np.flatnonzero(~bad & (np.diff(offsets) == dim))
        m = flat[offsets[rows][:, None] + np.arange(dim)[None, :]] if dim else np.zeros((len(rows), 0))
        if nonzero:
            some = (m != 0).any(axis=1)
            rows, m = rows[some], m[some]
            m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0))[1][:, None])
        if len(rows):
            found[int(dim)] = (keys[rows], m)
    return found


def blocks(vectors: DataFrame, size: int, nonzero: bool, method=None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(dim, block, n, ids, vectors, made): rows of one dimension, at most ``size`` a block, numbered uniquely; ``made`` by the method."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, list] = {}

        def out(dim: int):
            nonlocal done
            ids, m = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            for lo in range(0, len(ids), size):
                part, own = m[lo : lo + size], ids[lo : lo + size]
                made = [x.tobytes() for x in method.table(part)] if method else []
                columns = [pa.array([dim], pa.int32()), pa.array([base + done]), pa.array([len(own)], pa.int32()), pa.array([own.tobytes()]), pa.array([part.tobytes()]), pa.array([made], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "block", "n", "ids", "vectors", "made"])
                done += 1

        for batch in batches:
            for dim, rows in _usable(batch, nonzero).items():
                waiting.setdefault(dim, []).append(rows)
                if sum(len(x[0]) for x in waiting[dim]) >= size:
                    yield from out(dim)
        for dim in list(waiting):
            yield from out(dim)

    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return given.mapInArrow(run, _BLOCK)


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(vectors, float).reshape(len(keys), dim)


class Best:
    """The k best rows of each query so far: higher scores first, ties to smaller keys."""

    def __init__(self, queries: int, k: int, kind):
        self.k, self.count = k, np.zeros(queries, np.int64)
        self.scores, self.keys = np.zeros((queries, k), kind), np.zeros((queries, k), np.int64)

    def least(self, i: int):
        """What a row must reach to count (None: anything)."""
        return self.scores[i, -1] if self.count[i] == self.k else None

    def add(self, i: int, scores: np.ndarray, keys: np.ndarray) -> None:
        n = self.count[i]
        scores, keys = np.concatenate([self.scores[i, :n], scores.astype(self.scores.dtype)]), np.concatenate([self.keys[i, :n], keys])
        order = np.lexsort((keys, -scores))[: self.k]
        self.count[i] = len(order)
        self.scores[i, : len(order)], self.keys[i, : len(order)] = scores[order], keys[order]


def _in_order(bound: np.ndarray, allowed: np.ndarray, step: int, best: Best, i: int, score, keys: np.ndarray) -> int:
    """Scores rows in the order of their bounds until no bound reaches the k-th best; how many were scored."""
    rows, done = np.flatnonzero(allowed), 0
    least = best.least(i)
    if least is not None:
        rows = rows[bound[rows] >= least]
    if len(rows) > step:  # the most promising first: they raise the bar for the rest
        first = rows[np.argpartition(-bound[rows], step)[:step]]
        best.add(i, score(first), keys[first])
        done, least = step, best.least(i)
        rest = np.setdiff1d(rows, first, assume_unique=True)
        rows = rest[bound[rest] >= least] if least is not None else rest
        rows = rows[np.argsort(-bound[rows], kind="stable")]
    for lo in range(0, len(rows), step):
        least = best.least(i)
        if least is not None and bound[rows[lo]] < least and done:
            break
        part = rows[lo : lo + step]
        best.add(i, score(part), keys[part])
        done += len(part)
    return done


def search(vectors: DataFrame, queries: DataFrame, k: int, method, score: str, nonzero: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row.

    ``method.table(rows)`` gives the arrays stored beside a block,
    ``method.asked(queries)`` what is made once of a block of queries, and
    ``method.meet(asked, queries, q_keys, rows, keys, made, best)`` adds the
    rows of a block to the best of each query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    rows = scratch.save(blocks(vectors, BLOCK, nonzero, method), "rows")
    asked = scratch.save(blocks(queries, QUERY_BLOCK, nonzero), "queries")
    chunks = int(-(-(asked.agg(F.sum(F.col("n") * F.col("dim"))).first()[0] or 0) // CHUNK))
    kinds = f"q_row long, query_id long, vec_id long, score {score}"
    best, paths = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"), []
    for chunk in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("block"), F.lit(chunks)) == chunk).select("dim", "block", "ids", "vectors").toArrow().to_pylist()
        sent = spark.sparkContext.broadcast([(r["dim"], r["block"], r["ids"], r["vectors"]) for r in mine])
        found = rows.mapInArrow(_meeting(sent, method, k, score), kinds)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        scratch.save(ranked, f"best{chunk}")
        paths.append(f"{scratch.root}/best{chunk}")
        sent.destroy()
    if not paths:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    return spark.read.schema(f"query_id long, rank int, vec_id long, score {score}").parquet(*paths)


def _meeting(sent, method, k: int, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for dim, block, ids, vectors in sent.value:
            q_keys, q = _matrix(ids, vectors, dim)
            asked.append((dim, block, q_keys, q, method.asked(q), Best(len(q_keys), k, np.int64 if score == "long" else float)))
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vectors, made = (batch.column(c)[i].as_py() for c in (0, 3, 4, 5))
                keys, m = _matrix(ids, vectors, dim)
                for q_dim, _, q_keys, q, ready, best in asked:
                    if q_dim == dim:
                        method.meet(ready, q, q_keys, m, keys, made, best)
        for _, block, q_keys, _, _, best in asked:
            at, place = np.nonzero(np.arange(k)[None, :] < best.count[:, None])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array((block << 12) + at), pa.array(q_keys[at]), pa.array(best.keys[at, place]), pa.array(best.scores[at, place])], names=["q_row", "query_id", "vec_id", "score"])

    return run


def query_rows(vectors: DataFrame, every: int, id_column: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return vectors.where(F.col(id_column) % every == 0)


# ---------------------------------------------------------------- operator 7


def quantised(m: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component."""
    return np.floor(256.0 * m)


class Pivots:
    """Exact top-k by inner product with pivot-table elimination.

    With d(a, b) the Euclidean distance, a.b = (|a|^2 + |b|^2 - d^2) / 2, and
    d(a, b) >= |d(a, p) - d(b, p)| for every pivot p; the largest of these
    lower bounds over the stored table of pivot distances gives an upper bound
    on the score.  Rows are evaluated in the order of that bound until the k-th
    best score is above the next bound.  Stored distances are rounded; the lower
    bound is taken less what they, at most, are off by for this row and query.
    Scores that might leave 63 bits are an error.
    """

    #: Rounding of norms and products (53 bits), as a share of the squared norms.
    ROUNDING = 1e-12
    #: Rounding of a stored distance (24 bits), as a share of the norms of its row and pivot; for 64 components.
    STORED = 2.0**-21
    #: A sample point may be a pivot if its norm is at most this many times the median norm.
    FAR = 1000.0

    def __init__(self, k: int, points: dict[int, np.ndarray], step: int = 256):
        self.k, self.points, self.step = k, points, step

    @staticmethod
    def far_points(sample: dict[int, np.ndarray], pivots: int = 64) -> dict[int, np.ndarray]:
        """Pivots of each dimension: the origin, then sample points each as far as can be from those before it.

        The distances to a very far point differ by less than they are rounded
        by, so points far outside the rest are no pivots.
        """
        found = {}
        for dim, m in sample.items():
            m = quantised(m)
            norms = np.linalg.norm(m, axis=1)
            m = m[norms <= Pivots.FAR * np.median(norms)]
            points, apart = [np.zeros(dim)], (m**2).sum(axis=1)
            while len(points) < pivots and apart.max(initial=0) > 0:
                points.append(m[apart.argmax()])
                apart = np.minimum(apart, ((m - points[-1]) ** 2).sum(axis=1))
            found[dim] = np.array(points)
        return found

    def _far(self, m: np.ndarray) -> np.ndarray:
        points = self.points.get(m.shape[1], np.zeros((1, m.shape[1])))
        squares = (m**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * m @ points.T
        return np.sqrt(np.maximum(squares, 0)).astype(np.float32)

    def table(self, rows: np.ndarray) -> list[np.ndarray]:
        return [self._far(quantised(rows))]

    def asked(self, queries: np.ndarray) -> np.ndarray:
        return self._far(quantised(queries))

    def meet(self, asked: np.ndarray, queries: np.ndarray, q_keys: np.ndarray, rows: np.ndarray, keys: np.ndarray, made: list[bytes], best: Best) -> int:
        q, m = quantised(queries), quantised(rows)
        norms, q_norms = (m**2).sum(axis=1), (q**2).sum(axis=1)
        if np.sqrt(norms.max(initial=0)) * np.sqrt(q_norms.max(initial=0)) >= 2.0**63:
            raise ArithmeticError("inner products of these vectors may not fit into 63 bits")
        points = self.points.get(m.shape[1])
        reach = 2 * np.sqrt((points**2).sum(axis=1).max()) if points is not None else 0.0
        stored = self.STORED * max(1.0, np.sqrt(m.shape[1] / 64))
        slack = stored * (np.sqrt(norms) + reach)
        table = np.ascontiguousarray(np.frombuffer(made[0], np.float32).reshape(len(m), -1).T)
        if max(np.abs(q).max(initial=0), 1) * max(np.abs(m).max(initial=0), 1) * max(m.shape[1], 1) >= 2.0**53:
            q, m = q.astype(np.int64), m.astype(np.int64)
        scored, low, gap = 0, np.empty(len(m), np.float32), np.empty(len(m), np.float32)
        for i in range(len(q)):
            low[:] = 0
            for to_pivot, distance in zip(table, asked[i]):
                np.subtract(to_pivot, distance, out=gap)
                np.maximum(low, np.abs(gap, out=gap), out=low)
            both = norms + q_norms[i]
            sound = np.maximum(low - (slack + stored * np.sqrt(q_norms[i])), 0)
            bound = (both * (1 + self.ROUNDING) - sound**2) / 2 + 0.5
            scored += _in_order(bound, keys != q_keys[i], self.step, best, i, lambda part: m[part] @ q[i], keys)  # noqa: B023
        return scored


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 64, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): highest integer inner products of quantised vectors, ties to the smaller vec_id.

    Pivots are chosen from at most ``sample`` rows, those of least hash; the
    result does not depend on them.  A pair of vectors whose norms multiply to
    2**63 or more is an error, as its score need not fit into a long.
    """
    some = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null")
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks().to_batches()
    points = Pivots.far_points({dim: m for b in some for dim, (_, m) in _usable(b, False).items()}, pivots)
    return search(vectors, queries, k, Pivots(k, points), "long", nonzero=False)


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, query_rows(vectors, 50))


EXACT_SQL = r"""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product([CAST(x AS DOUBLE) for x in a.q], [CAST(x AS DOUBLE) for x in b.q]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# ---------------------------------------------------------------- operator 9


class OneBit:
    """Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

    A unit vector o is embedded in ``bits`` dimensions by a random rotation;
    the stored code is the sign of each coordinate (64 to a word), beside it
    the correction scalar <x, o> with x the unit vector of the signs.  A
    rotated unit query is rounded to ``levels`` bit planes, so <x, q> comes
    from counts of common bits; <x, q> / <x, o> estimates <o, q>, within
    ``width`` standard errors of the code, sqrt((1 - s^2) / s^2 / (bits - 1))
    for s = <x, o>, and of the rounding, with high probability.  Rows are
    reranked with their exact cosine in the order of the estimate's upper
    bound until no bound reaches the k-th best.
    """

    def __init__(self, k: int, bits: int = 256, width: float = 2.6, step: int = 256, seed: int = 9, levels: int = 4):
        self.k, self.bits, self.width, self.step, self.seed, self.levels = k, bits, width, step, seed, levels
        self._rotations: dict[int, np.ndarray] = {}

    def rotation(self, dim: int) -> np.ndarray:
        if dim not in self._rotations:
            size = 64 * -(-max(self.bits, dim) // 64)
            full, _ = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((size, size)))
            self._rotations[dim] = full[:, :dim]
        return self._rotations[dim]

    def __getstate__(self):
        return {**self.__dict__, "_rotations": {}}

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)

    def table(self, rows: np.ndarray) -> list[np.ndarray]:
        """Packed codes, correction scalars and norms."""
        norms = np.linalg.norm(rows, axis=1)
        turned = (rows / norms[:, None]) @ self.rotation(rows.shape[1]).T
        return [self._words(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), norms]

    def asked(self, queries: np.ndarray) -> tuple:
        norms = np.linalg.norm(queries, axis=1)
        turned = (queries / norms[:, None]) @ self.rotation(queries.shape[1]).T
        low = turned.min(axis=1, keepdims=True)
        unit = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << self.levels) - 1)
        rounded = np.rint((turned - low) / unit).astype(np.uint8)
        planes = np.stack([self._words(rounded >> j & 1) for j in range(self.levels)], axis=1)
        return norms, turned.sum(axis=1), low[:, 0], unit[:, 0], planes

    def meet(self, asked: tuple, queries: np.ndarray, q_keys: np.ndarray, rows: np.ndarray, keys: np.ndarray, made: list[bytes], best: Best) -> int:
        q_norms, sums, low, unit, planes = asked
        codes = np.frombuffer(made[0], np.uint64).reshape(len(rows), -1)
        scalar, norms = np.frombuffer(made[1]), np.frombuffer(made[2])
        size, ones, scored = 64 * codes.shape[1], np.bitwise_count(codes).sum(axis=1, dtype=np.int64), 0
        spread = np.maximum(1 - scalar**2, 0) / (size - 1)
        for i in range(len(queries)):
            common = sum(np.bitwise_count(codes & planes[i, j]).sum(axis=1, dtype=np.int64) << j for j in range(self.levels))
            # <x, q> = (2 * sum of q over set bits - sum of q) / sqrt(size)
            against = (2 * (low[i] * ones + unit[i] * common) - sums[i]) / np.sqrt(size)
            upper = (against + self.width * np.sqrt(spread + unit[i] ** 2 / 3)) / scalar
            exact = lambda part: (rows[part] * queries[i]).sum(axis=1) / (norms[part] * q_norms[i])  # noqa: B023, E731
            scored += _in_order(upper, keys != q_keys[i], self.step, best, i, exact, keys)
        return scored


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 256, width: float = 2.6) -> DataFrame:
    """(query_id, rank, vec_id, score): rows of largest cosine found, ties to the smaller vec_id."""
    return search(vectors, queries, k, OneBit(k, bits, width), "double", nonzero=True)


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, query_rows(vectors, 50))
