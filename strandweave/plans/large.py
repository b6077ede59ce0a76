"""Queries of the operators that take one large sequence, graph or matrix over the whole cluster."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.functions import sequences as fs
from strandweave.operators import frontier, graphs, large_matrices, long_sequences, nerve, paths, words
from strandweave.plans import registry as r
from strandweave.session import Scratch

#: Every source as one circular sequence: its documents in the order of their ids.
GENOMES = f"SELECT source AS seq_id, string_agg(s, '' ORDER BY seq_id) AS s FROM ({r.SEQS}) GROUP BY 1"


def genomes(spark, d):
    """The same as chunks; the source's name becomes a number by its digits.  The letters are made once and saved."""
    letters = F.udf(fs.pseudo_dna_of, "string", useArrow=True)
    docs = r.spread(r.table(spark, d, "documents").select("doc_id", "source", "text"))
    docs = docs.select(F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("seq_id"), "doc_id", letters("text").alias("seq"))
    docs = Scratch(spark, "genomes").save(docs, "letters")
    return long_sequences.joined(docs, "doc_id", F.expr("doc_id div 10000"))


@r.query("genome_arcs", f"""
WITH g AS MATERIALIZED (SELECT CAST(regexp_extract(seq_id, '(\\d+)$', 1) AS BIGINT) AS seq_id, s, length(s) AS n FROM ({GENOMES})),
b AS MATERIALIZED (SELECT seq_id, n, b, substr(s || substr(s, 1, 30), b * 1000 + 1, 1030) AS c FROM (SELECT *, unnest(range((n + 999) // 1000)) AS b FROM g WHERE n >= 31)),
o AS (SELECT seq_id, n, CAST(b * 1000 + i AS BIGINT) AS pos, substr(c, i + 1, 31) AS kmer FROM (SELECT *, unnest(range(least(1000, n - b * 1000))) AS i FROM b)),
q AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY seq_id, kmer) > 1)
SELECT seq_id, pos, kmer AS tail, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS head,
       CAST(coalesce(lead(pos) OVER w, first_value(pos) OVER w + n) - pos AS BIGINT) AS span
FROM q WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def genome_arcs(spark, d):
    return long_sequences.compacted_arcs(genomes(spark, d), 31).drop("strand")


# ---------------------------------------------------------------- matrices and nerves

_SIDES = "2 * l_orderkey AS a, 2 * l_partkey + 1 AS b"
_MADE = "2 * l_suppkey AS a, 2 * l_partkey + 1 AS b"
#: Least vertex of each component, as a fixpoint that keeps one row a vertex; s is (a, b) in both directions.
_LEAST = """l(v, c) USING KEY (v) AS (SELECT DISTINCT a, a FROM s
  UNION SELECT s.b, min(n.c) FROM l n JOIN s ON s.a = n.v JOIN recurring.l o ON o.v = s.b WHERE n.c < o.c GROUP BY s.b)"""


@r.query("order_part_rank", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT {_SIDES} FROM lineitem), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), {_LEAST},
n AS (SELECT count(*) AS vertices, count(*) - count(*) FILTER (WHERE v = c) AS rank FROM l)
SELECT vertices, (SELECT count(*) FROM e) AS arcs, rank, (SELECT count(*) FROM e) - rank AS cycles FROM n""")
def order_part_rank(spark, d):
    """Rank, modulo 2**31 - 1, of the incidence matrix of orders and parts (one row a pair), and the rank of its cycle space."""
    line = r.table(spark, d, "lineitem").select(F.col("l_orderkey") * 2**31 + F.col("l_partkey"), F.col("l_orderkey") * 2, F.col("l_partkey") * 2 + 1).toDF("i", "a", "b")
    cells = line.select("i", F.explode(F.map_from_arrays(F.array("a", "b"), F.array(F.lit(1), F.lit(-1)))).alias("j", "value"))
    rank = large_matrices.rank(cells)
    sizes = cells.agg(F.count_distinct("j").alias("vertices"), F.count_distinct("i").alias("arcs"))
    return sizes.select("vertices", "arcs", F.lit(rank).cast("long").alias("rank"), (F.col("arcs") - rank).alias("cycles"))


@r.query("flag_nerve", f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT l_returnflag || l_linestatus AS f, {_MADE} FROM lineitem),
p AS MATERIALIZED (SELECT f, a AS v FROM m UNION SELECT f, b FROM m), f AS (SELECT DISTINCT f FROM m),
k AS MATERIALIZED (SELECT array_to_string(k, ',') AS k, len(k) AS n, unnest(k) AS f FROM (
  SELECT [f] AS k FROM f UNION ALL SELECT [x.f, y.f] FROM f x JOIN f y ON x.f < y.f UNION ALL SELECT [x.f, y.f, z.f] FROM f x JOIN f y ON x.f < y.f JOIN f z ON y.f < z.f)),
s AS MATERIALIZED (WITH t AS (SELECT k, a, b FROM m JOIN k USING (f) GROUP BY k, a, b, n HAVING count(*) = n)
  SELECT k, a, b FROM t UNION SELECT k, b, a FROM t UNION SELECT k, v, v FROM p JOIN k USING (f) GROUP BY k, v, n HAVING count(*) = n),
l(k, v, c) USING KEY (k, v) AS (SELECT DISTINCT k, a, a FROM s
  UNION SELECT s.k, s.b, min(n.c) FROM l n JOIN s ON s.k = n.k AND s.a = n.v JOIN recurring.l o ON o.k = s.k AND o.v = s.b WHERE n.c < o.c GROUP BY s.k, s.b)
SELECT k AS sigma, count(*) AS vertices, count(*) FILTER (WHERE v = c) AS components FROM l GROUP BY 1""")
def flag_nerve(spark, d):
    """Components that sets of up to three flag pairs have in common, in the graph of suppliers and parts; flag pairs are strains."""
    line = r.table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"), F.concat("l_returnflag", "l_linestatus").alias("f"))
    arcs = nerve.gathered(line, "f", "u", "v")
    vertices = nerve.gathered(line.select("f", F.explode(F.array("u", "v")).alias("v")), "f", "v")
    return nerve.component_counts(nerve.cells(vertices, arcs)).select(F.array_join("sigma", ",").alias("sigma"), "vertices", "components")


# ---------------------------------------------------------------- paths and strong components

_NAMES = "SELECT p_partkey AS seq_id, p_name AS s FROM part"
_GRAM = f"SELECT seq_id AS graph_id, kmer AS u, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS v FROM ({r.circular(_NAMES, 2)}) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@r.query("labelled_unitigs", f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT graph_id, u, v, count(*) AS m, right(v, 1) AS label FROM ({_GRAM}) GROUP BY 1, 2, 3),
g AS (SELECT graph_id, x, sum(o) AS o, sum(i) AS i FROM (SELECT graph_id, u AS x, m AS o, 0 AS i FROM a UNION ALL SELECT graph_id, v, 0, m FROM a) GROUP BY 1, 2),
n AS MATERIALIZED (SELECT graph_id, x FROM g WHERE o = 1 AND i = 1),
w AS (SELECT a.graph_id, a.u, a.v, a.m, 1 AS arcs, a.label FROM a LEFT JOIN n ON n.graph_id = a.graph_id AND n.x = a.u WHERE n.x IS NULL
      UNION ALL SELECT w.graph_id, w.u, a.v, w.m, w.arcs + 1, w.label || a.label FROM w JOIN n ON n.graph_id = w.graph_id AND n.x = w.v JOIN a ON a.graph_id = w.graph_id AND a.u = w.v)
SELECT w.graph_id, w.u, w.v, CAST(w.m AS BIGINT) AS m, CAST(w.arcs AS BIGINT) AS arcs, w.label FROM w LEFT JOIN n ON n.graph_id = w.graph_id AND n.x = w.v WHERE n.x IS NULL""")
def labelled_unitigs(spark, d):
    """Maximal paths of the two-letter word graph of each part name, with the letters that they spell."""
    part = r.dealt(r.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq")))
    arcs = words.word_arcs(part, 2)
    return paths.labelled_unitigs(arcs.withColumn("label", F.expr("right(v, 1)")))


@r.query("return_circles", """
WITH RECURSIVE r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R'),
a AS MATERIALIZED (SELECT DISTINCT l_partkey AS u, v FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS v FROM r) WHERE v IS NOT NULL),
n AS (SELECT u AS x FROM a UNION SELECT v FROM a),
t AS (SELECT x AS o, x AS z FROM n UNION SELECT t.o, a.v FROM t JOIN a ON a.u = t.z)
SELECT f.o AS part, min(f.z) AS component FROM t f JOIN t b ON b.o = f.z AND b.z = f.o GROUP BY 1""")
def return_circles(spark, d):
    """Strong components of parts, where a part leads to the one of the same order that was shipped next and came back as well."""
    back = r.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    arcs = back.select(F.lit(0).alias("graph_id"), F.col("l_partkey").alias("u"), after.alias("v")).where("v is not null")
    return paths.strong_components(arcs).select(F.col("v").alias("part"), "component")


# ---------------------------------------------------------------- frontier

_KIND = "CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'error' THEN 'error' ELSE 'trade' END"
_M = "coalesce(max(m) FILTER (WHERE u = '{0}' AND v = '{1}'), 0) AS {2}".format
_FREE = ", ".join(_M(u, v, n) for u, v, n in (("browse", "error", "be"), ("error", "browse", "eb"), ("browse", "trade", "bt"), ("trade", "browse", "tb"), ("error", "trade", "et"), ("trade", "error", "te"), ("browse", "browse", "bb"), ("error", "error", "ee"), ("trade", "trade", "tt")))


@r.query("balanced_walk_parts", f"""
WITH k AS (SELECT user_id, ts, event_id, {_KIND} AS kind FROM events),
a AS (SELECT user_id AS graph_id, kind AS u, coalesce(lead(kind) OVER w, first_value(kind) OVER w) AS v FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS MATERIALIZED (SELECT graph_id, {_FREE} FROM (SELECT graph_id, u, v, count(*) AS m FROM a GROUP BY 1, 2, 3) GROUP BY 1),
x AS (SELECT *, unnest(range(be + 1)) AS x1 FROM g), y AS (SELECT *, unnest(range(bt + 1)) AS x2 FROM x), z AS (SELECT *, unnest(range(eb + 1)) AS x3 FROM y), t AS (SELECT *, unnest(range(et + 1)) AS x4 FROM z WHERE x1 + x2 - x3 BETWEEN 0 AND tb),
n AS (SELECT graph_id, count(*) FILTER (WHERE x3 + x4 - x1 BETWEEN 0 AND te) AS n FROM t GROUP BY 1)
SELECT graph_id, CAST(n * (bb + 1) * (ee + 1) * (tt + 1) AS VARCHAR) AS choices FROM n JOIN g USING (graph_id)""")
def balanced_walk_parts(spark, d):
    """How many parts of each user's walk between kinds of events are balanced: the kinds are vertices, the steps arcs."""
    kind = F.when(F.col("event_type").isin("click", "view"), "browse").when(F.col("event_type") == "error", "error").otherwise("trade")
    events = r.table(spark, d, "events").withColumn("kind", kind)
    arcs = graphs.walk_arcs(events, "user_id", ["ts", "event_id"], "kind", F.to_date("ts"))
    return frontier.balanced_choices(arcs).select("graph_id", F.col("choices").cast("string").alias("choices"))


@r.query("supplier_part_units", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT {_MADE} FROM lineitem), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), {_LEAST}
SELECT count(*) - count(*) FILTER (WHERE v = c) AS pivots, CAST(0 AS BIGINT) AS left_over FROM l""")
def supplier_part_units(spark, d):
    """Unit pivots of the incidence matrix of suppliers and parts over the integers; a graph leaves nothing over."""
    pairs = r.table(spark, d, "lineitem").select(F.col("l_suppkey") * 2**31 + F.col("l_partkey"), F.col("l_suppkey") * 2, F.col("l_partkey") * 2 + 1).toDF("i", "a", "b").distinct()
    pivots, left = large_matrices.unit_pivots(pairs.select("i", F.explode(F.map_from_arrays(F.array("a", "b"), F.array(F.lit(1), F.lit(-1)))).alias("j", "value")))
    return left.agg(F.lit(pivots).cast("long").alias("pivots"), F.count("*").alias("left_over"))


_LABELS = "SELECT p_partkey AS seq_id, p_name || p_brand || p_type AS s FROM part"


@r.query("detachments", f"""
WITH t AS (SELECT graph_id, u, v, row_number() OVER (PARTITION BY graph_id, u, v) AS c FROM (
  SELECT seq_id AS graph_id, kmer AS u, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS v FROM ({r.circular(_LABELS, 1)}) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
x AS (SELECT graph_id, v AS vertex FROM t GROUP BY 1, 2 HAVING count(*) = 3 AND count(*) FILTER (WHERE u = v) = 0),
i AS (SELECT t.graph_id, t.v AS vertex, t.u AS far, row_number() OVER (PARTITION BY t.graph_id, t.v ORDER BY t.u, t.c) AS n FROM t JOIN x ON x.graph_id = t.graph_id AND x.vertex = t.v),
o AS (SELECT t.graph_id, t.u AS vertex, t.v AS far, row_number() OVER (PARTITION BY t.graph_id, t.u ORDER BY t.v, t.c) AS n FROM t JOIN x ON x.graph_id = t.graph_id AND x.vertex = t.u),
k AS (SELECT graph_id, vertex, CAST(h AS INTEGER) AS head, CAST(l AS INTEGER) AS tail FROM x, range(1, 4) a(h), range(1, 4) b(l)),
e AS (SELECT k.*, far AS u, CASE WHEN n = head THEN k.vertex || '''' ELSE k.vertex END AS v FROM k JOIN i ON i.graph_id = k.graph_id AND i.vertex = k.vertex
  UNION ALL SELECT k.*, CASE WHEN n = tail THEN k.vertex ELSE k.vertex || '''' END, far FROM k JOIN o ON o.graph_id = k.graph_id AND o.vertex = k.vertex
  UNION ALL SELECT k.*, k.vertex, k.vertex || '''' FROM k)
SELECT graph_id, vertex, head, tail, u, v, count(*) AS m FROM e GROUP BY ALL""")
def detachments(spark, d):
    """Letters that occur three times in a part's name, brand and type, split in nine ways in the graph of which letter follows which."""
    part = r.dealt(r.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.concat("p_name", "p_brand", "p_type").alias("seq")))
    return graphs.detachments(words.word_arcs(part, 1))
