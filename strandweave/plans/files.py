"""Queries of the file readers and sinks: tables go out to files in the shared folder and come back through a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.plans import registry as r
from strandweave.session import Scratch
from strandweave.sources import fasta_ranges as ranges
from strandweave.sources import sequences as src


@r.query("fasta_round_trip", f"SELECT 'd' || seq_id AS name, coalesce(source, '') || '>' || coalesce(lang, '') AS description, s AS seq FROM ({r.SEQS})")
def fasta_round_trip(spark, d):
    """All sequences as FASTA, each header with a description that holds a ">"."""
    path = f"{Scratch(spark, 'files').root}/fasta"
    head = F.concat(F.lit("d"), F.col("seq_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(">"), F.coalesce("lang", F.lit("")))
    src.write_fasta(r.dna(spark, d).select(head.alias("name"), F.coalesce("seq", F.lit("")).alias("seq")), path)
    return src.read_fasta(spark, path).select("name", "description", "seq")


@r.query("plain_files", "SELECT CAST(n_nationkey AS INTEGER) AS nation, upper(replace(n_name, ' ', '')) AS seq FROM nation")
def plain_files(spark, d):
    """One file for each nation."""
    path = f"{Scratch(spark, 'files').root}/plain"
    r.table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(path)
    return src.read_plain(spark, path).select(F.regexp_extract("name", r"n_nationkey=(\d+)", 1).cast("int").alias("nation"), "seq")


@r.query("feature_tables", """
SELECT CAST(p_partkey * 100 AS BIGINT) AS start, CAST(p_partkey * 100 + p_size AS BIGINT) AS "end", CASE WHEN p_size % 2 = 1 THEN '-' ELSE '+' END AS strand, 'CDS' AS kind, p_name AS product
FROM part WHERE p_size % 3 <> 0""")
def feature_tables(spark, d):
    """Parts as features: odd sizes on the other strand, every third size of a kind that is not asked for."""
    path = f"{Scratch(spark, 'files').root}/features"
    low, high = (F.col("p_partkey") * 100).cast("string"), (F.col("p_partkey") * 100 + F.col("p_size")).cast("string")
    turned = F.col("p_size") % 2 == 1
    kind = F.when(F.col("p_size") % 3 == 0, "gene").otherwise("CDS")
    line = F.concat_ws("\t", F.when(turned, high).otherwise(low), F.when(turned, low).otherwise(high), kind)
    r.table(spark, d, "part").select(F.concat(line, F.lit("\n\t\t\tproduct\t"), "p_name").alias("value")).write.text(path)
    return src.read_features(spark, path)


@r.query("protein_tables", """
SELECT 'P' || c_custkey AS accession, c_name AS gene, c_mktsegment AS family, upper(c_name) AS seq FROM customer WHERE c_custkey % 7 <> 0""")
def protein_tables(spark, d):
    """Customers as proteins; every seventh has no sequence and is left out by the reader."""
    path = f"{Scratch(spark, 'files').root}/proteins"
    seq = F.when(F.col("c_custkey") % 7 != 0, F.upper("c_name"))
    rows = r.table(spark, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("accession"), F.col("c_name").alias("gene"), F.concat("c_mktsegment", F.lit("; other")).alias("families"), F.length(seq).alias("length"), seq.alias("sequence"))
    rows.write.csv(path, sep="\t", header=True, compression="gzip")
    return src.read_proteins(spark, path)


@r.query("resumed_results", "SELECT CAST(n_nationkey AS BIGINT) AS batch, n_name AS name, n_nationkey % 2 = 1 AS resumed FROM nation")
def resumed_results(spark, d):
    """A run that stopped after the even batches and computes only the others when it is started again."""
    nation = r.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("batch"), F.col("n_name").alias("name"))
    results = src.ResultTable(spark, f"{Scratch(spark, 'files').root}/results", "name string, resumed boolean")
    results.add("run", nation.where("batch % 2 = 0").withColumn("resumed", F.lit(False)))
    results.add("run", results.pending("run", nation).withColumn("resumed", F.lit(True)))
    return results.rows().where("sig = 'run'").select("batch", "name", "resumed")


@r.query("fasta_ranges", f"SELECT 'd' || seq_id AS name, coalesce(source, '') || '>' || coalesce(lang, '') AS description, s AS seq FROM ({r.SEQS})")
def fasta_ranges(spark, d):
    """The same round trip through the source of byte ranges, in small ranges and chunks."""
    path = f"{Scratch(spark, 'files').root}/fasta"
    head = F.concat(F.lit("d"), F.col("seq_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(">"), F.coalesce("lang", F.lit("")))
    src.write_fasta(r.dna(spark, d).select(head.alias("name"), F.coalesce("seq", F.lit("")).alias("seq")), path)
    return ranges.whole_records(ranges.read(spark, path, 1 << 18, 1 << 12)).select("name", "description", "seq")
