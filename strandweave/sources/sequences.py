"""Readers of sequence files, feature tables and protein tables, and their sinks.

Every reader has a fixed schema and takes any path that Spark can read; there
is no download: fetch files first and give their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQUENCES = "seq_id long, name string, description string, seq string"


def _clean(seq, policy: str):
    """``raise`` fails on letters outside ACGT, ``mask`` writes A for them, ``keep`` leaves them."""
    if policy == "mask":
        return F.regexp_replace(seq, "[^ACGT]", "A")
    if policy == "raise":
        return F.when(seq.rlike("[^ACGT]"), F.raise_error(F.lit("a sequence has letters outside ACGT"))).otherwise(seq)
    if policy == "keep":
        return seq
    raise ValueError(f"unknown cleaning policy {policy!r}")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one sequence each: seq_id, name (the path), seq in upper case."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.upper(F.regexp_replace("value", r"\s", "")).alias("seq"))
    return text.select(F.monotonically_increasing_id().alias("seq_id"), "name", F.lit(None).cast("string").alias("description"), "seq")


def read_fasta(spark: SparkSession, path: str, policy: str = "keep") -> DataFrame:
    """Records of FASTA files: seq_id, name, description, seq (lines joined, upper case).

    Files are split at lines that begin with ">" by the reader itself, so a
    large file is read by many tasks and no record is gathered.  seq_id tells
    the records of one reading apart; it depends on the splits.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim(F.col("value")) != "")
    head = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", ""))
    made = records.select(F.monotonically_increasing_id().alias("seq_id"), F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("description"), _clean(seq, policy).alias("seq"))
    return made.select(F.col("seq_id").cast("long").alias("seq_id"), "name", "description", "seq")


def normalised_isolates(records: DataFrame, reference: str, k: int = 12, low: int = 5300, high: int = 5500, least_share: float = 0.5, most: int | None = None) -> DataFrame:
    """Complete circular relatives of a reference, on its strand and from its origin.

    Keeps records of plain letters within a length range; takes the strand that
    shares more k-letter words with the reference; rotates to the reference's
    first k letters where they occur exactly once; drops records that share less
    than ``least_share`` and repeats of an earlier sequence; first ``most``.
    """
    from strandweave.functions.sequences import reverse_complement
    from strandweave.operators.words import both_strands, occurrences

    spark = records.sparkSession
    kept = records.where(F.length("seq").between(low, high) & ~F.col("seq").rlike("[^ACGT]")).select("seq_id", "name", "seq")
    known = occurrences(spark.createDataFrame([(0, reference)], "seq_id long, seq string"), k).select("kmer").distinct()
    total = known.count()
    words = occurrences(both_strands(kept), k, keys=("seq_id", "strand")).select("seq_id", "strand", "kmer").distinct()
    share = words.join(known, "kmer", "left_semi").groupBy("seq_id").agg(F.sum((F.col("strand") == 0).cast("long")).alias("plus"), F.sum((F.col("strand") == 1).cast("long")).alias("minus"))
    voted = kept.join(share, "seq_id").where(F.greatest("plus", "minus") >= least_share * total)
    turned = voted.withColumn("seq", F.when(F.col("minus") > F.col("plus"), reverse_complement("seq")).otherwise(F.col("seq")))
    start = reference[:k]
    circle = F.concat("seq", F.substring("seq", 1, k - 1))
    at = F.instr(circle, start)
    rotated = F.concat(F.substring("seq", at, F.length("seq")), F.substring("seq", F.lit(1), at - 1))
    once = F.size(F.split(circle, start)) == 2
    turned = turned.withColumn("seq", F.when(once, rotated).otherwise(F.col("seq")))
    first = turned.withColumn("_r", F.row_number().over(Window.partitionBy("seq").orderBy("seq_id"))).where("_r = 1").drop("_r")
    out = first.orderBy("seq_id").select("seq_id", "name", "seq")
    return out.limit(most) if most else out


def read_features(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("rRNA", "CDS", "mobile_element", "repeat_region"), shard: int = 1 << 16) -> DataFrame:
    """Feature tables of tab-separated lines (start, end, kind, attribute, value): start, end, strand, kind, product.

    A line with a kind opens a feature; the lines below it carry attributes, of
    which the first product, mobile_element_type, rpt_family or gene names it.
    The strand is "-" where start is beyond end; coordinates are 1-based closed.
    Lines are ordered in shards of ``shard`` lines of a split, so no task orders
    a file; a shard begins with the feature that the shards before it left open.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    named = cell(3).isin("product", "mobile_element_type", "rpt_family", "gene")
    opens = F.coalesce(cell(2) != "", F.lit(False))
    parsed = lines.where(opens | named).select("file", "split", F.expr(f"line div {shard}").alias("shard"), "line", opens.alias("opens"), named.alias("named"), *(F.when(opens, F.regexp_replace(cell(i), "[<>]", "")).alias(n) for i, n in enumerate(("a", "b"))), F.when(opens, cell(2)).alias("kind"), F.when(named, cell(4)).alias("value"))
    key = ["file", "split", "shard"]
    opened = F.when(F.col("opens"), F.col("line"))
    inside = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("split", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = parsed.groupBy(*key).agg(F.max(opened).alias("last")).select(*key, F.last("last", ignorenulls=True).over(before).alias("last"))
    placed = parsed.withColumn("feature", F.last(opened, ignorenulls=True).over(inside)).join(shards, key)
    whole = placed.withColumn("feature", F.coalesce("feature", "last")).groupBy("file", "feature")
    # a feature has one line that opens it, so any aggregate of its cells is that line's
    heads = [F.max(c).alias(c) for c in ("a", "b", "kind")]
    found = whole.agg(*heads, F.min_by("value", F.when(F.col("named"), F.col("line"))).alias("product"))
    number = F.col("kind").isin(*kinds) & F.col("a").rlike(r"^\d+$") & F.col("b").rlike(r"^\d+$")
    made = found.where(number).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "kind", "product")
    return made.select(F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), F.when(F.col("a") > F.col("b"), "-").otherwise("+").alias("strand"), "kind", F.coalesce("product", F.lit("")).alias("product"))


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Protein tables with a header (accession, gene, families, length, sequence), plain or gzip: accession, gene, family, seq."""
    rows = spark.read.schema("accession string, gene string, families string, length string, sequence string").csv(path, sep="\t", header=True)
    return rows.where(F.col("sequence").isNotNull() & (F.col("sequence") != "")).select("accession", F.coalesce("gene", F.lit("")).alias("gene"), F.coalesce(F.split("families", ";")[0], F.lit("")).alias("family"), F.col("sequence").alias("seq"))


def write_fasta(seqs: DataFrame, path: str, width: int = 70) -> None:
    """FASTA text files of (name, seq), lines of ``width`` letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")).write.text(path)


class ResultTable:
    """Batch results that a run can resume from, a partition for each (sig, batch).

    Adding a batch again, by a retry after a partial write or by a second
    writer, replaces its partition, so its results are there once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], f"sig string, batch long, {self.schema}")
        return self.spark.read.schema(f"sig string, batch long, {self.schema}").parquet(self.path)

    def pending(self, sig: str, batches: DataFrame) -> DataFrame:
        """Batches (column ``batch``) without a result under this signature."""
        return batches.join(self.rows().where(F.col("sig") == sig).select("batch"), "batch", "left_anti")

    def add(self, sig: str, results: DataFrame) -> None:
        names = [c.strip().split()[0] for c in self.schema.split(",")]
        made = results.select(F.lit(sig).alias("sig"), F.col("batch").cast("long").alias("batch"), *names)
        made.write.partitionBy("sig", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
