"""Identities that hold on any tables, as rows (check, expected, found, ok), and further queries of column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sequences as fs
from strandweave.operators import complements, graphs, words
from strandweave.plans import registry as r


def check_row(name: str, expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row from two tables of one number each."""
    e, f = expected.toDF("expected"), found.toDF("found")
    return e.join(F.broadcast(f)).select(F.lit(name).alias("check"), F.col("expected").cast("long").alias("expected"), F.col("found").cast("long").alias("found"), F.col("expected").eqNullSafe(F.col("found")).alias("ok"))


def _zero(spark) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long"))


@r.query("check_rows", f"""
WITH s AS MATERIALIZED ({r.SEQS}), a AS MATERIALIZED ({r.ARCS}),
d AS (SELECT graph_id, x, sum(o) AS o, sum(i) AS i FROM (SELECT graph_id, u AS x, m AS o, 0 AS i FROM a UNION ALL SELECT graph_id, v, 0, m FROM a) GROUP BY 1, 2)
SELECT * FROM (
  SELECT 'words of sequences' AS "check", (SELECT CAST(sum(length(s)) AS BIGINT) FROM s WHERE length(s) >= 12) AS expected
  UNION ALL SELECT 'words unlike their reverse complements', 0
  UNION ALL SELECT 'circles not closed by their arcs', 0
  UNION ALL SELECT 'unbalanced walks', 0
  UNION ALL SELECT 'Laplacian rows with a sum', 0
  UNION ALL SELECT 'arcs of line digraphs', (SELECT CAST(sum(o * i) AS BIGINT) FROM d)
  UNION ALL SELECT 'steps of walks', (SELECT count(*) FROM events)) t, LATERAL (SELECT expected AS found, true AS ok)""")
def check_rows(spark, d):
    """Counts that two ways of computing must give, over whole tables; each row names one."""
    seqs, arcs = r.dna(spark, d), r.walks(spark, d)
    counts = words.word_counts(seqs, 12, circular=True)
    both = words.word_counts(words.both_strands(seqs), 8, circular=True)
    turned = both.select(fs.reverse_complement("kmer").alias("kmer"), F.col("n").alias("m"))
    unlike = both.join(turned, "kmer", "left").where("m is null or n <> m")
    spans = words.compacted_arcs(seqs, 12).groupBy("seq_id").agg(F.sum("span").alias("way")).join(seqs.select("seq_id", F.length("seq").alias("n")), "seq_id")
    degrees = graphs.degrees(arcs)
    rows = [
        check_row("words of sequences", seqs.where(F.length("seq") >= 12).agg(F.sum(F.length("seq"))), counts.agg(F.sum("n"))),
        check_row("words unlike their reverse complements", _zero(spark), unlike.agg(F.count("*"))),
        check_row("circles not closed by their arcs", _zero(spark), spans.where("way <> n").agg(F.count("*"))),
        check_row("unbalanced walks", _zero(spark), graphs.balance(arcs).where("not balanced").agg(F.count("*"))),
        check_row("Laplacian rows with a sum", _zero(spark), graphs.laplacian(arcs).groupBy("graph_id", "i").agg(F.sum("value").alias("s")).where("s <> 0").agg(F.count("*"))),
        check_row("arcs of line digraphs", degrees.agg(F.sum(F.col("indegree") * F.col("outdegree"))), graphs.line_digraph(arcs).agg(F.sum("m"))),
        check_row("steps of walks", r.table(spark, d, "events").agg(F.count("*")), arcs.agg(F.sum("m"))),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@r.query("exponent_quotients", """
WITH g AS (SELECT l_orderkey, list_reverse_sort(list(l_linenumber)) AS p, list_reverse_sort(list(CAST(l_quantity AS BIGINT) % 8)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey AS orderkey, len([i FOR i IN range(1, len(p) + 1) IF q[i] > p[i]]) = 0 AS quotient FROM g""")
def exponent_quotients(spark, d):
    """Whether the group with the exponents of an order's quantities (modulo 8) is a quotient of the one with its line numbers."""
    line = r.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.collect_list(F.col("l_linenumber").cast("long")).alias("p"), F.collect_list(F.col("l_quantity").cast("long") % 8).alias("q"))
    return line.select("orderkey", fs.is_quotient("p", "q").alias("quotient"))


def _words_of(lang: str, k: int) -> str:
    return f"SELECT DISTINCT kmer FROM ({r.circular(r.SEQS + f" WHERE lang = '{lang}'", k)})"


@r.query("spectrum_sides", f"""
WITH a AS MATERIALIZED ({_words_of('en', 9)}), b AS MATERIALIZED ({_words_of('de', 9)})
SELECT coalesce(a.kmer, b.kmer) AS kmer, CASE WHEN b.kmer IS NULL THEN 'en' ELSE 'de' END AS side FROM a FULL JOIN b ON a.kmer = b.kmer WHERE a.kmer IS NULL OR b.kmer IS NULL""")
def spectrum_sides(spark, d):
    """Words that only one of two languages has, with the side that has them."""
    seqs = r.dna(spark, d).where("lang in ('en', 'de')")
    sides = words.word_counts(seqs.select("lang", "seq"), 9, circular=True, keys=("lang",))
    one = sides.groupBy("kmer").agg(F.count("*").alias("n"), F.min("lang").alias("side"))
    return one.where("n = 1").select("kmer", "side")


_STATUS = "[CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT)]"
_GOAL = [10, 12, 11]


@r.query("complement_triples", f"""
WITH c AS (SELECT o_custkey AS id, {_STATUS} AS p FROM orders GROUP BY 1),
g AS MATERIALIZED (SELECT p, count(*) AS n, min(id) AS f FROM c WHERE p[1] <= {_GOAL[0]} AND p[2] <= {_GOAL[1]} AND p[3] <= {_GOAL[2]} GROUP BY 1),
t AS (SELECT a.p AS a, b.p AS b, c.p AS c, a.n AS na, b.n AS nb, c.n AS nc, a.f AS fa, b.f AS fb, c.f AS fc FROM g a JOIN g b ON a.p <= b.p
  JOIN g c ON c.p = [{_GOAL[0]} - a.p[1] - b.p[1], {_GOAL[1]} - a.p[2] - b.p[2], {_GOAL[2]} - a.p[3] - b.p[3]] AND b.p <= c.p),
w AS (SELECT *, CASE WHEN a = c THEN na * (na - 1) * (na - 2) // 6 WHEN a = b THEN na * (na - 1) // 2 * nc WHEN b = c THEN na * (nb * (nb - 1) // 2) ELSE na * nb * nc END AS ways FROM t)
SELECT array_to_string(a, ',') || ';' || array_to_string(b, ',') || ';' || array_to_string(c, ',') AS vectors, fa || ',' || fb || ',' || fc AS firsts, ways FROM w WHERE ways > 0""")
def complement_triples(spark, d):
    """Classes of three customers whose order-status counts add up to (10, 12, 11)."""
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    rows = r.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array(n("F"), n("O"), n("P")).alias("p"))
    found = complements.complement_classes(rows, _GOAL, 3)
    spelled = F.array_join(F.transform("vectors", lambda v: F.array_join(v.cast("array<string>"), ",")), ";")
    return found.select(spelled.alias("vectors"), F.array_join(F.col("firsts").cast("array<string>"), ",").alias("firsts"), "ways")
