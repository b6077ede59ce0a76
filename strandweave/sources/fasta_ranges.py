"""A FASTA source whose partitions are byte ranges of files, with ids that no split changes.

A record belongs to the range its ">" lies in and is read from there on, beyond
the end of the range if need be.  Its id is (file, offset): the place of that
">" in bytes.  Long records come as several rows, each with the place of its
first letter, so a task holds one block of a file and one chunk of letters,
however long a record or a line is.

    sources.fasta_ranges.register(spark)
    spark.read.format("sw_fasta").option("path", path).option("range", 64 << 20).load()

Options: ``path`` (a file or a folder, searched in depth without names that
begin with "_" or "."), ``range`` (bytes of a partition) and ``chunk`` (letters
of a row).  Paths are opened through Arrow's file systems (local, HDFS, S3).
Letters are upper-cased and white space between them is dropped; text before
the first ">" of a file is no record; a record without letters is a row of its
own with an empty ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, offset bigint, name string, description string, start bigint, seq string"
RANGE, CHUNK, BLOCK = 64 << 20, 1 << 16, 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _pieces(f, at: int) -> Iterator[tuple[int, bytes, bool]]:
    """(place, bytes, whether a line ends with them): lines, or parts of lines longer than a block."""
    while block := f.read(BLOCK):
        lo = 0
        while lo < len(block):
            cut = block.find(b"\n", lo)
            hi = cut if cut >= 0 else len(block)
            yield at + lo, block[lo:hi], cut >= 0
            lo = hi + 1 if cut >= 0 else hi
        at += len(block)


class _Record:
    def __init__(self, file: str, offset: int, chunk: int):
        self.file, self.offset, self.chunk = file, offset, chunk
        self.head, self.letters, self.start = bytearray(), bytearray(), 0

    def row(self, n: int) -> tuple:
        name, _, description = bytes(self.head[1:]).decode().strip().partition(" ")
        seq = bytes(self.letters[:n]).decode().upper()
        del self.letters[:n]
        row = (self.file, self.offset, name, description.strip(), self.start, seq)
        self.start += n
        return row

    def full(self) -> Iterator[tuple]:
        while len(self.letters) > self.chunk:
            yield self.row(self.chunk)

    def rest(self) -> Iterator[tuple]:
        yield from self.full()
        if self.letters or not self.start:
            yield self.row(len(self.letters))


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.chunk = options["path"], int(options.get("range", RANGE)), int(options.get("chunk", CHUNK))
        if self.size < 1 or self.chunk < 1:
            raise ValueError("range and chunk must be positive")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, place = _opened(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        root = self.path.rstrip("/")
        found = [(root, info.size)]
        if info.type == fs.FileType.Directory:
            inside = [i for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File]
            names = [(i.path[len(place.rstrip("/")) + 1 :], i.size) for i in inside]
            found = sorted((f"{root}/{n}", size) for n, size in names if not any(p.startswith(("_", ".")) for p in n.split("/")))
        return [Range(file, lo, min(lo + self.size, size)) for file, size in found for lo in range(0, size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.begin >= partition.end:
            return
        system, place = _opened(partition.file)
        with system.open_input_file(place) as f:
            # from the byte before: whether a line begins with the range
            at = max(partition.begin - 1, 0)
            f.seek(at)
            fresh, heading, record = partition.begin == 0, False, None
            for place, piece, ends in _pieces(f, at):
                if fresh and place >= partition.end and (record is None or piece[:1] == b">"):
                    break
                if fresh and piece[:1] == b">":
                    if record:
                        yield from record.rest()
                    record, heading = _Record(partition.file, place, self.chunk), True
                if heading:
                    record.head += piece
                    heading = not ends
                elif record:
                    record.letters += piece.translate(None, b" \t\r\x0b\x0c")
                    yield from record.full()
                fresh = ends
            if record:
                yield from record.rest()


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sw_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def read(spark: SparkSession, path: str, size: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    register(spark)
    return spark.read.format("sw_fasta").option("path", path).option("range", size).option("chunk", chunk).load()


def whole_records(rows: DataFrame) -> DataFrame:
    """(file, offset, name, description, seq): records that fit into a row, put together again."""
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return rows.groupBy("file", "offset", "name", "description").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))


def chunks(rows: DataFrame) -> DataFrame:
    """The rows as chunks of circular sequences (seq_id, strand, n, start, seq), seq_id a number for each (file, offset)."""
    from strandweave.session import Scratch

    sizes = rows.groupBy("file", "offset").agg(F.max(F.col("start") + F.length("seq")).alias("n")).withColumn("seq_id", F.monotonically_increasing_id())
    sizes = Scratch(rows.sparkSession, "fasta").save(sizes, "sizes")
    return rows.join(sizes, ["file", "offset"]).select("seq_id", F.lit(0).alias("strand"), "n", "start", "seq")
