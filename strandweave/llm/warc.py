"""Merkle fixity audit of WARC replicas (operator 6).

A leaf is the SHA-256 of one record's bytes together with the offset range it
occupies in its file; an inner node hashes ``fanout`` ordered children of the
level below; the top of a file is one node.  Trees of two replicas are built
independently, level by level, with one aggregation each.  The audit compares
the nodes of the top level and joins only the children of mismatching nodes on
each level below, so a sound archive costs one comparison a file and a damaged
record ``depth`` comparisons.

Every level groups by (file, node), at most ``fanout`` rows a group, so no
task gathers a file; everything is built from SQL functions.

Edge cases: nulls in url or html are empty strings; records without a page_id
are spread over files -1 to -4096 by content; the records of one page_id are
split by digest; repeated rows are records of their own, ordered by content; a
record of any length is hashed whole where it is read, and only its digest
travels; a record that only one replica has is reported as missing or extra;
empty replicas give no rows; other columns of the pages are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.session import Scratch

FANOUT, RECORDS_PER_FILE = 8, 128
#: Hex digits of a digest that name a shard of a page_id's records.
SHARD_DIGITS = 3
#: Files that records without a page_id are spread over.
NULL_FILES = 4096


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """WARC response records: page_id, file, record, length, digest."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NULL_FILES)))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), file.cast("long").alias("file"), record.alias("record"))
    return made.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256))


def indexed(made: DataFrame) -> DataFrame:
    """Records in the order of their files (page_id, digest), with ordinal and offset.

    The records of one page_id are cut into shards by the head of their digest:
    ordinals and offsets are counted inside shards, and over the shards of a
    file, so a page_id that holds most records is not ordered by one task.
    """
    key = ["file", "_page", "_shard"]
    cut = made.withColumn("_page", F.coalesce("page_id", F.lit(0))).withColumn("_shard", F.substring("digest", 1, SHARD_DIGITS))
    inside = Window.partitionBy(*key).orderBy("digest")
    before = Window.partitionBy("file").orderBy("_page", "_shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shards = cut.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("length").alias("_l"))
    shards = shards.select(*key, F.coalesce(F.sum("_n").over(before), zero).alias("_n"), F.coalesce(F.sum("_l").over(before), zero).alias("_l"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("_i", F.row_number().over(inside).cast("long") - 1).withColumn("_o", F.sum("length").over(upto) - F.col("length"))
    placed = cut.join(shards, key)
    return placed.select(*made.columns, (F.col("_i") + F.col("_n")).alias("ordinal"), (F.col("_o") + F.col("_l")).alias("offset"))


def leaves(made: DataFrame) -> DataFrame:
    """(file, ordinal, offset, length, digest): what one replica holds at each place of the index."""
    return made.select("file", "ordinal", "offset", "length", "digest")


def tree(scratch: Scratch, base: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels (file, node, hash) from the leaves up to one node a file."""
    leaf = F.sha2(F.concat_ws("|", "ordinal", "offset", "length", "digest"), 256)
    level = scratch.save(base.select("file", F.col("ordinal").alias("node"), leaf.alias("hash")), f"{name}-0")
    levels = [level]
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        grouped = level.groupBy("file", F.expr(f"node div {fanout}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below"))
        joined = F.array_join(F.transform("below", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), "|")
        level = scratch.save(grouped.select("file", "node", F.sha2(joined, 256).alias("hash")), f"{name}-{len(levels)}")
        levels.append(level)
    return levels


def audit(expected: DataFrame, found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that differ: file, ordinal, offset, length, expected, found, status (corrupt, missing or extra).

    ``expected`` and ``found`` have the columns of :func:`leaves`.
    """
    spark = expected.sparkSession
    scratch = Scratch(spark, "fixity")
    expected, found = scratch.save(expected, "expected"), scratch.save(found, "found")
    ours, theirs = tree(scratch, expected, fanout, "ours"), tree(scratch, found, fanout, "theirs")
    depth = max(len(ours), len(theirs))
    # the shorter tree grows by single-child nodes, which the hash of one child defines
    ours, theirs = (_raise(scratch, t, depth, n) for t, n in ((ours, "ours"), (theirs, "theirs")))
    bad = None
    for k in reversed(range(depth)):
        a, b = ours[k], theirs[k]
        if bad is not None:
            parents = bad.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.expr(f"node div {fanout}")).join(parents, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        joined = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full").where("not (hash <=> other)")
        bad = scratch.save(joined.select("file", "node"), f"bad-{k}")
    leaf = bad.select("file", F.col("node").alias("ordinal"))
    e = expected.join(leaf, ["file", "ordinal"]).select("file", "ordinal", "offset", "length", F.col("digest").alias("expected"))
    f = found.join(leaf, ["file", "ordinal"]).select("file", "ordinal", F.col("offset").alias("o"), F.col("length").alias("l"), F.col("digest").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return e.join(f, ["file", "ordinal"], "full").select("file", "ordinal", F.coalesce("offset", "o").alias("offset"), F.coalesce("length", "l").alias("length"), "expected", "found", status.alias("status"))


def _raise(scratch: Scratch, levels: list[DataFrame], depth: int, name: str) -> list[DataFrame]:
    while len(levels) < depth:
        top = levels[-1].select("file", "node", F.sha2(F.concat(F.col("node").cast("string"), F.lit(":"), F.col("hash")), 256).alias("hash"))
        levels = [*levels, scratch.save(top, f"{name}-{len(levels)}")]
    return levels


def damaged(made: DataFrame) -> DataFrame:
    """A replica with reproducible damage: records whose digest begins with 0 have a byte
    more (column ``hurt``), those that begin with 10 are gone (their place in the index is empty)."""
    return made.where(~F.col("digest").startswith("10")).withColumn("digest", F.when(F.col("digest").startswith("0"), F.col("hurt")).otherwise(F.col("digest")))


def fixity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a damaged replica of all pages; one row per record that differs."""
    made = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    made = made.select("page_id", "file", "length", "digest", F.sha2(F.concat("record", F.lit("!")), 256).alias("hurt"))
    scratch = Scratch(spark, "warc")
    # written once: the index reads the digests twice, the pages are hashed once
    made = scratch.save(indexed(scratch.save(made, "digests")), "records")
    differing = audit(leaves(made), leaves(damaged(made)))
    names = made.select("file", "ordinal", "page_id")
    return differing.join(names, ["file", "ordinal"], "left").select("page_id", "file", "ordinal", "offset", "length", "expected", "found", "status")


FIXITY_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 128) AS BIGINT) AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
d AS (SELECT *, CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS expected FROM r),
o AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal, CAST(sum(length) OVER w - length AS BIGINT) AS "offset" FROM d
      WINDOW w AS (PARTITION BY file ORDER BY page_id, expected ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, file, ordinal, "offset", length, expected, CASE WHEN expected LIKE '0%' THEN sha256(record || '!') END AS found,
       CASE WHEN expected LIKE '0%' THEN 'corrupt' ELSE 'missing' END AS status
FROM o WHERE expected LIKE '0%' OR expected LIKE '10%'
"""
