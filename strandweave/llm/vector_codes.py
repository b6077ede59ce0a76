"""Product codes of vectors, trained by Lloyd's rounds with Hamerly's bounds (operator 12).

Each component x becomes the integer floor(scale * x); a vector is cut into
``parts`` equal consecutive parts, and every part position has a codebook of
``entries`` integer vectors.  The codebooks start as the parts of the rows of
smallest vec_id.  A round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to the
componentwise floor of the mean of its parts; unused entries stay.

A part keeps two bounds between rounds: ``upper`` on the distance to its own
entry and ``lower`` on the distance to the second nearest.  When entries move,
upper grows by the move of the own entry and lower shrinks by the largest move
of any other.  While upper is strictly below lower, or strictly below half the
distance of the own entry to its nearest fellow, no other entry can be as
near, so the part keeps its index; else upper is made exact, and only if it
still is not strictly below, all distances are computed, in integers.  Bounds
are stored in 24 bits, upper rounded up and lower rounded down, so a tie never
passes them and the result is that of a full scan in every round.

Rows travel in blocks of bounded size, written with their codes and bounds
once a round to the shared folder and never shuffled.  A task adds up its
parts by entry; what reaches the driver is one codebook (entries times
dimension integers), whatever the number of rows.

Edge cases: rows whose vector is null or holds null or non-finite components
are left out, and so are rows whose length differs from that of the first
usable row by vec_id (one whose length is a positive multiple of ``parts``).
A null vec_id comes after all others; rows that repeat a vec_id are rows of
their own, ordered by their components.  Fewer rows than ``entries`` make
smaller codebooks.  Null labels are one label.  Components so large that a
squared distance may not fit into 62 bits are an error.  An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import Scratch

LOG = logging.getLogger(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Components of a block; also at most this many rows.
BLOCK, BLOCK_ROWS = 1 << 18, 4096
#: A label with at least this share of all rows is joined by broadcast: at most 1 / SHARE labels.
SHARE = 0.001


def quantised(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), checked so that squared distances of whole vectors fit into 62 bits."""
    q = np.floor(scale * m)
    if np.abs(q).max(initial=0) * 2 * np.sqrt(max(m.shape[1], 1)) >= 2.0**31:
        raise ArithmeticError("squared distances of these vectors may not fit into 62 bits")
    return q.astype(np.int32)


def distances(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each part to each entry, exact."""
    q = q.astype(np.int64)
    return (q * q).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (q @ book.T)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Book:
    """The codebook of one part position, with what its last move says about bounds."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = np.sqrt(distances(entries, entries).astype(float))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1, initial=np.inf) / 2
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(float))
        self.moved = moved
        others = np.tile(moved, (len(moved), 1))
        np.fill_diagonal(others, 0.0)
        self.others = others.max(axis=1, initial=0.0)

    def assign(self, q: np.ndarray, codes: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New codes and bounds, and how many parts were compared with all entries."""
        if codes is None:
            codes, upper, lower = np.zeros(len(q), np.uint8), np.zeros(len(q), np.float32), np.zeros(len(q), np.float32)
            rows = np.arange(len(q))
        else:
            codes = codes.copy()
            upper, lower = _up(upper + self.moved[codes]), _down(lower - self.others[codes])
            need = np.maximum(lower, _down(self.half)[codes])
            rows = np.flatnonzero(~(upper < need))
            own = q[rows].astype(np.int64) - self.entries[codes[rows]]
            upper[rows] = _up(np.sqrt((own * own).sum(axis=1).astype(float)))
            rows = rows[~(upper[rows] < need[rows])]
        if len(rows):
            far = distances(q[rows], self.entries)
            best = far.argmin(axis=1)  # of equal ones the first
            codes[rows] = best
            at = np.arange(len(rows))
            upper[rows] = _up(np.sqrt(far[at, best].astype(float)))
            if far.shape[1] > 1:
                far[at, best] = np.iinfo(np.int64).max
                lower[rows] = _down(np.sqrt(far.min(axis=1).astype(float)))
            else:
                lower[rows] = np.inf
        return codes, upper, lower, len(rows)


class Pass:
    """One assignment of all parts of the blocks a task reads."""

    def __init__(self, books: list[Book], dim: int, scale: float):
        self.books, self.dim, self.scale = books, dim, scale
        self.parts, self.width = len(books), dim // len(books)

    def parts_of(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, p * self.width : (p + 1) * self.width] for p in range(self.parts)]

    def assign(self, q: np.ndarray, state: tuple | None) -> tuple[tuple, int]:
        made, scanned = [], 0
        for p, (book, part) in enumerate(zip(self.books, self.parts_of(q))):
            codes, upper, lower, n = book.assign(part, *((s[p] for s in state) if state else (None, None, None)))
            made.append((codes, upper, lower))
            scanned += n
        return tuple(np.stack(x) for x in zip(*made)), scanned

    def unpack(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(ids, labels, q, state) of each block of a written round."""
        for i in range(batch.num_rows):
            ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
            q = np.frombuffer(batch.column("q")[i].as_py(), np.int32).reshape(len(ids), self.dim)
            kinds = (("codes", np.uint8), ("upper", np.float32), ("lower", np.float32))
            yield ids, labels, q, tuple(np.frombuffer(batch.column(c)[i].as_py(), k).reshape(self.parts, len(ids)) for c, k in kinds)

    def raw_blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The same of rows of the input."""
        size, waiting, held = max(1, min(BLOCK_ROWS, BLOCK // self.dim)), [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            while held >= size:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                yield self._raw(whole.slice(0, size))
                waiting, held = whole.slice(size).to_batches(), held - size
        if held:
            yield self._raw(pa.Table.from_batches(waiting))

    def _raw(self, rows: pa.Table) -> tuple:
        ids, labels, vectors = (rows.column(c).combine_chunks() for c in ("id", "label", "v"))
        m = np.asarray(vectors.flatten(), float).reshape(len(rows), self.dim)
        return ids, labels, quantised(m, self.scale), None

    def round(self, blocks: Iterator[tuple], label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Blocks with new codes and bounds, then the sums of this task's parts by entry (``sums``) and the parts scanned."""
        size = len(self.books[0].entries)
        sums, counts, scanned = np.zeros((self.parts, size, self.width), np.int64), np.zeros((self.parts, size), np.int64), 0
        names = ["ids", "labels", "q", "codes", "upper", "lower", "sums", "counts", "scanned"]
        for ids, labels, q, state in blocks:
            state, n = self.assign(q, state)
            scanned += n
            for p, part in enumerate(self.parts_of(q)):
                hot = state[0][p][None, :] == np.arange(size, dtype=np.uint8)[:, None]
                sums[p] += np.rint(hot.astype(float) @ part).astype(np.int64)  # at most 2**43 in each block
                counts[p] += hot.sum(axis=1)
            values = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(label_type)), *(pa.array([x.tobytes()]) for x in (q, *state))]
            yield pa.RecordBatch.from_arrays([*values, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64())], names=names)
        if counts.any():
            empty = [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(label_type)), *(pa.nulls(1, pa.binary()) for _ in range(4))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums.ravel()], pa.list_(pa.int64())), pa.array([counts.ravel()], pa.list_(pa.int64())), pa.array([scanned])], names=names)

    def coded(self, blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Row by row: vec_id, label, code, error."""
        for ids, labels, q, state in blocks:
            (codes, _, _), _ = self.assign(q, state)
            error = np.zeros(len(ids), np.int64)
            for p, (book, part) in enumerate(zip(self.books, self.parts_of(q))):
                gap = part.astype(np.int64) - book.entries[codes[p]]
                error += (gap * gap).sum(axis=1)
            hexes = codes.T.tobytes().hex()
            step = 2 * self.parts
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([hexes[i : i + step] for i in range(0, len(hexes), step)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _label_type(vectors: DataFrame, label: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.select(F.col(label)).schema[0].dataType
    return kind.simpleString(), to_arrow_type(kind)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row, and the codebooks (parts x entries x width integers)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so a codebook has at most 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    label_sql, label_type = _label_type(vectors, label_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    first = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    out = f"vec_id long, label {label_sql}, code string, error long"
    if first is None:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    dim = first[0]
    rows = rows.where(F.size("v") == dim)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = quantised(np.array([r[0] for r in start], float), scale).astype(np.int64)
    width = dim // parts
    books = [Book(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    kinds = f"ids array<long>, labels array<{label_sql}>, q binary, codes binary, upper binary, lower binary, sums array<long>, counts array<long>, scanned long"
    blocks, name = rows, ""
    for number in range(rounds):
        step = Pass(books, dim, scale)
        read = step.raw_blocks if number == 0 else _blocks_of(step)
        written = scratch.save(blocks.mapInArrow(lambda it, step=step, read=read: step.round(read(it), label_type), kinds), f"round{number}")
        if name:
            scratch.drop(name)
        name = f"round{number}"
        books = _moved(books, written.where("sums is not null"), number)
        blocks = written.where("q is not null")
    step = Pass(books, dim, scale)
    read = _blocks_of(step) if rounds else step.raw_blocks
    coded = scratch.save(blocks.mapInArrow(lambda it: step.coded(read(it)), out), "coded")
    if name:
        scratch.drop(name)
    return coded, np.stack([b.entries for b in books])


def _blocks_of(step: Pass):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from step.unpack(batch)

    return read


def _moved(books: list[Book], sums: DataFrame, number: int) -> list[Book]:
    """Codebooks after a round; the sums of all tasks are added up as decimals, by place, before they are collected."""
    big = F.col("value").cast("decimal(38,0)")
    total = {}
    for what in ("sums", "counts"):
        added = sums.select(F.posexplode(what).alias("at", "value")).groupBy("at").agg(F.sum(big).alias("value")).orderBy("at")
        total[what] = [int(r["value"]) for r in added.collect()]
    scanned = sums.agg(F.sum("scanned")).first()[0]
    size, width = books[0].entries.shape
    counts = total["counts"]
    LOG.info("vector codes: round %d compared %d of %d parts with all entries", number + 1, scanned, sum(counts))
    made = []
    for p, book in enumerate(books):
        entries = book.entries.copy()
        for e in range(size):
            n = counts[p * size + e]
            if n:
                at = (p * size + e) * width
                entries[e] = [s // n for s in total["sums"][at : at + width]]
        made.append(Book(entries, book.entries))
    return made


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over the rows of equal label (nulls together).

    A label with a share of ``SHARE`` of the rows or more meets its sum by
    broadcast (there are at most 1 / SHARE of them), the others by a join.
    """
    total = coded.count()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    hot = F.col("_n") >= max(1, SHARE * total)
    heavy = F.broadcast(sums.where(hot).select(F.col("label").alias("_label"), "label_error"))
    light = sums.where(~hot).select(F.col("label").alias("_label"), F.col("label_error").alias("_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    marked = coded.join(heavy, same, "left").drop("_label")
    rest = marked.where("label_error is null").join(light, same).withColumn("label_error", F.col("_error")).drop("_label", "_error")
    return marked.where("label_error is not null").unionByName(rest)


def code_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _code_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({int(SCALE)} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""w AS MATERIALIZED (SELECT vec_id, i // (len(q) // {parts}) AS part, i % (len(q) // {parts}) AS pos, q[i + 1] AS x FROM (SELECT vec_id, q, unnest(range(len(q))) AS i FROM v))""",
        f"""c0 AS MATERIALIZED (SELECT part, e AS entry, pos, x AS c FROM w JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) USING (vec_id) WHERE e < {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {entries} + entry) AS m FROM (
   SELECT vec_id, w.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM w JOIN c{r} k ON w.part = k.part AND w.pos = k.pos GROUP BY ALL) GROUP BY ALL)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k.part, k.entry, k.pos, coalesce(s, k.c) AS c FROM c{r} k LEFT JOIN (
   SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS s FROM (
     SELECT w.part, m % {entries} AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM w JOIN a{r} USING (vec_id, part) GROUP BY ALL)) u USING (part, entry, pos))"""
            )
    steps.append(
        f"""h AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM h JOIN v USING (vec_id)
"""
    )


CODE_SQL = _code_sql()
