"""Every query of the library outside the optional corpus subpackage, with oracle SQL where there is one.

Feeds: whole texts of ``documents`` as linear words; their letters mapped to
A, C, G, T as circular sequences; ``events`` of each user as a circular walk
over event types; the order hierarchy as a DAG; parts and orders as edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandweave.functions import sequences as fs
from strandweave.operators import counting, graphs, pools, words
from strandweave.sources import generators

QUERIES: dict = {}
ORACLES: dict = {}
#: Published values of small literal inputs, by name: (function, SQL of what is known); for tests, not registered.
PUBLISHED: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def published(name: str, sql: str | None = None):
    def put(f):
        PUBLISHED[name] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few splits dealt out for the CPU work that follows; a table of many stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """A table of short rows dealt out evenly, four lots a core: a small file may hold millions of them in one split."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), "source", "lang", fs.pseudo_dna("text").alias("seq"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return graphs.walk_arcs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", day)


# ---------------------------------------------------------------- SQL building blocks

DNA = "translate(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))".format


def circular(source: str, k: int) -> str:
    """Words of circular sequences: source gives (seq_id, s [, more])."""
    return f"SELECT * EXCLUDE (c, s), substr(c, i + 1, {k}) AS kmer FROM (SELECT *, s || substr(s, 1, {k - 1}) AS c, unnest(range(length(s))) AS i FROM ({source}) WHERE length(s) >= {k})"


SEQS = f"SELECT doc_id AS seq_id, source, lang, {DNA} AS s FROM documents"
STRANDS = f"SELECT seq_id, 0 AS strand, s, length(s) AS n FROM ({SEQS}) UNION ALL SELECT seq_id, 1, {RC('s')}, length(s) FROM ({SEQS})"
STEPS = """SELECT user_id, event_type AS u, coalesce(lead(event_type) OVER w, first_value(event_type) OVER w) AS v FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
ARCS = f"SELECT user_id AS graph_id, u, v, count(*) AS m FROM ({STEPS}) GROUP BY 1, 2, 3"
BIG = "CAST({0} AS BIGINT)".format

# ---------------------------------------------------------------- words


@query("kmer_spectrum", "SELECT substr(text, i, 5) AS kmer, count(*) AS n FROM (SELECT text, unnest(range(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 5) GROUP BY 1")
def kmer_spectrum(spark, d):
    return words.word_counts(spread(table(spark, d, "documents").select(F.col("text").alias("seq"))), 5)


@query("kmer_document_frequency", "SELECT kmer, count(*) AS n FROM (SELECT DISTINCT doc_id, substr(text, i, 4) AS kmer FROM (SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS i FROM documents WHERE length(text) >= 4)) GROUP BY 1")
def kmer_document_frequency(spark, d):
    return words.word_counts(spread(table(spark, d, "documents").select(F.col("text").alias("seq"))), 4, documents=True)


@query("circular_kmers", circular("SELECT p_partkey AS seq_id, p_name AS s FROM part", 4).replace("SELECT *", "SELECT seq_id, CAST(i AS BIGINT) AS pos, kmer FROM (SELECT *", 1) + ")")
def circular_kmers(spark, d):
    return words.occurrences(dealt(table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq"))), 4)


@query("repeated_kmers", f"SELECT seq_id, kmer, count(*) AS n FROM ({circular(SEQS, 12)}) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_kmers(spark, d):
    return words.occurrences(dna(spark, d), 12, repeated=True).groupBy("seq_id", "kmer").agg(F.count("*").alias("n"))


@query("compacted_arcs", f"""
WITH o AS (SELECT seq_id, i AS pos, n, kmer FROM ({circular(SEQS.replace("source, lang,", f"length({DNA}) AS n,"), 12)})),
r AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY seq_id, kmer) > 1)
SELECT seq_id, CAST(pos AS BIGINT) AS pos, kmer AS tail, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS head,
       CAST(coalesce(lead(pos) OVER w, first_value(pos) OVER w + n) - pos AS BIGINT) AS span
FROM r WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def compacted_arcs(spark, d):
    return words.compacted_arcs(dna(spark, d), 12)


COVER = f"""o AS MATERIALIZED (SELECT seq_id, strand, n, i AS pos, kmer FROM ({circular(STRANDS, 12)})),
r AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY seq_id, kmer) > 1),
a AS (SELECT seq_id, strand, pos, coalesce(lead(pos) OVER w, first_value(pos) OVER w + n) - pos AS span
      FROM r WINDOW w AS (PARTITION BY seq_id, strand ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT a.seq_id, a.strand, substr(s || s || s, pos + 1, span + 12) AS content FROM a JOIN ({STRANDS}) g ON g.seq_id = a.seq_id AND g.strand = a.strand),
c AS (SELECT seq_id, content, substr(content, 1, 12) AS tail, right(content, 12) AS head, count(*) AS m, sum(1 - strand) AS m0, {RC('content')} AS partner FROM t GROUP BY 1, 2)"""


@query("double_cover", f"WITH {COVER} SELECT seq_id, content, tail, head, m, {BIG('m0')} AS m0, partner, partner = content AS fixed FROM c")
def double_cover(spark, d):
    return words.double_cover(dna(spark, d), 12)


@query("double_cover_invariants", f"""
WITH {COVER},
v AS (SELECT seq_id, count(*) AS vertices, {BIG(f"sum(CASE WHEN tail = {RC('tail')} THEN 1 ELSE 0 END)")} AS fixed_vertices FROM (SELECT DISTINCT seq_id, tail FROM c) GROUP BY 1)
SELECT seq_id, vertices, fixed_vertices, count(*) AS contents, {BIG('sum(CASE WHEN partner = content THEN 1 ELSE 0 END)')} AS fixed_contents,
       {BIG('sum(m)')} AS occurrences, {BIG('sum(CASE WHEN content < partner THEN 1 ELSE 0 END)')} AS orbits
FROM c JOIN v USING (seq_id) GROUP BY 1, 2, 3""")
def double_cover_invariants(spark, d):
    return words.cover_summary(dna(spark, d), 12)


@query("double_cover_balance", f"""
WITH {COVER}, e AS (SELECT seq_id, tail AS x, m AS o, 0 AS i FROM c UNION ALL SELECT seq_id, head, 0, m FROM c),
b AS (SELECT seq_id, x, sum(o) = sum(i) AS ok FROM e GROUP BY 1, 2),
p AS (SELECT c.seq_id, bool_and(coalesce(q.m, 0) = c.m AND (c.content <> c.partner OR c.m % 2 = 0)) AS paired FROM c LEFT JOIN c q ON q.seq_id = c.seq_id AND q.content = c.partner GROUP BY 1)
SELECT b.seq_id, bool_and(ok) AS balanced, bool_and(paired) AS paired FROM b JOIN p USING (seq_id) GROUP BY 1""")
def double_cover_balance(spark, d):
    return words.cover_balance(dna(spark, d), 12)


@query("signed_quotient", f"""
WITH {COVER}
SELECT seq_id AS graph_id, least(tail, {RC('tail')}) AS u, least(head, {RC('head')}) AS v,
       CAST(CASE WHEN (tail <= {RC('tail')}) = (head <= {RC('head')}) THEN 1 ELSE -1 END AS INTEGER) AS sign, m FROM c WHERE content <= partner""")
def signed_quotient(spark, d):
    return graphs.signed_quotient(words.double_cover(dna(spark, d), 12))


@query("double_strand_spectrum", f"SELECT kmer, count(*) AS n FROM ({circular(STRANDS, 8)}) GROUP BY 1")
def double_strand_spectrum(spark, d):
    return words.word_counts(words.both_strands(dna(spark, d)), 8, circular=True)


@query("inverted_repeats", f"""
WITH o AS MATERIALIZED (SELECT seq_id, kmer, min(i) AS pos FROM ({circular(SEQS, 14)}) GROUP BY 1, 2)
SELECT a.seq_id, count(*) AS words, {BIG('sum(CASE WHEN a.kmer = b.kmer THEN 1 ELSE 0 END)')} AS palindromes, {BIG('min(a.pos)')} AS first_pos
FROM o a JOIN o b ON a.seq_id = b.seq_id AND b.kmer = {RC('a.kmer')} GROUP BY 1""")
def inverted_repeats(spark, d):
    return words.inverted_repeats(dna(spark, d), 14)


@query("pooled_branch_words", f"""
WITH o AS MATERIALIZED (SELECT DISTINCT source AS pool, kmer FROM ({circular(SEQS, 12)}))
SELECT pool, substr(kmer, 2, 10) AS kmer, count(DISTINCT right(kmer, 1)) AS successors, count(DISTINCT left(kmer, 1)) AS predecessors
FROM o GROUP BY 1, 2 HAVING count(DISTINCT right(kmer, 1)) > 1 OR count(DISTINCT left(kmer, 1)) > 1""")
def pooled_branch_words(spark, d):
    return words.pooled_branch_words(dna(spark, d).withColumn("pool", F.col("source")), 10, alphabet="ACGT")


@query("core_words", f"""
WITH o AS (SELECT DISTINCT lang AS pool, source AS member, kmer FROM ({circular(SEQS, 8)})),
n AS (SELECT pool, count(DISTINCT member) AS members FROM o GROUP BY 1), c AS (SELECT pool, kmer, count(*) AS c FROM o GROUP BY 1, 2)
SELECT pool, count(*) AS words, {BIG('sum(CASE WHEN c = members THEN 1 ELSE 0 END)')} AS core, {BIG('sum(CASE WHEN c = 1 THEN 1 ELSE 0 END)')} AS specific FROM c JOIN n USING (pool) GROUP BY 1""")
def core_words(spark, d):
    return words.shared_words(dna(spark, d).select(F.col("lang").alias("pool"), F.col("source").alias("member"), "seq"), 8)


@query("strand_votes", f"""
WITH r AS (SELECT DISTINCT substr(s, i + 1, 10) AS kmer FROM (SELECT s, unnest(range(0, length(s) - 9, 7)) AS i FROM ({SEQS}) WHERE length(s) >= 10 AND lang = 'en')),
q AS (SELECT seq_id, strand, substr(s, i + 1, 10) AS kmer FROM (SELECT seq_id, strand, s, unnest(range(0, length(s) - 9, 101)) AS i FROM ({STRANDS}) WHERE length(s) >= 10)),
h AS (SELECT seq_id, {BIG('sum(CASE WHEN strand = 0 THEN 1 ELSE 0 END)')} AS forward, {BIG('sum(strand)')} AS backward FROM q WHERE kmer IN (SELECT kmer FROM r) GROUP BY 1)
SELECT d.doc_id AS seq_id, coalesce(forward, 0) AS forward, coalesce(backward, 0) AS backward, coalesce(backward, 0) > coalesce(forward, 0) AS reverse
FROM documents d LEFT JOIN h ON h.seq_id = d.doc_id""")
def strand_votes(spark, d):
    s = dna(spark, d)
    return words.strand_votes(s.select("seq_id", "seq"), s.where("lang = 'en'").select("seq_id", "seq"), 10, 101, 7)


@query("spectrum_collisions", """
WITH t AS (SELECT DISTINCT p_name AS s FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT c_name FROM customer),
w AS (SELECT k, s, substr(s, i, k) AS kmer FROM (SELECT s, k, unnest(range(1, length(s) - k + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) v(k) WHERE length(s) >= k)),
c AS (SELECT k, s, kmer, count(*) AS n FROM w GROUP BY 1, 2, 3), g AS (SELECT k, s, string_agg(kmer || ':' || n, '|' ORDER BY kmer) AS key FROM c GROUP BY 1, 2),
q AS (SELECT k, key, count(*) AS c FROM g GROUP BY 1, 2 HAVING count(*) > 1)
SELECT CAST(v.k AS INTEGER) AS k, count(q.c) AS classes, CAST(coalesce(sum(q.c), 0) AS BIGINT) AS members FROM (VALUES (1), (2), (3), (4)) v(k) LEFT JOIN q ON q.k = v.k GROUP BY 1""")
def spectrum_collisions(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("seq")).union(part.select("p_brand")).union(table(spark, d, "customer").select("c_name"))
    return words.spectrum_collisions(names, [1, 2, 3, 4])


# ---------------------------------------------------------------- scalar functions


@query("reverse_complements", f"SELECT seq_id, {RC('s')} AS rc, s = {RC('s')} AS palindrome FROM ({SEQS})")
def reverse_complements(spark, d):
    rc = fs.reverse_complement("seq")
    return dna(spark, d).select("seq_id", rc.alias("rc"), (rc == F.col("seq")).alias("palindrome"))


@query("least_rotations", """
SELECT p_partkey, min(substr(s, i) || substr(s, 1, i - 1)) AS rotation FROM (SELECT p_partkey, p_name || p_brand AS s, unnest(range(1, length(p_name || p_brand) + 1)) AS i FROM part) GROUP BY 1""")
def least_rotations(spark, d):
    return table(spark, d, "part").select("p_partkey", fs.least_rotation(F.concat("p_name", "p_brand")).alias("rotation"))


@query("differing_positions", """
WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, len([i for i in range(1, least(length(a), length(b)) + 1) if substr(a, i, 1) <> substr(b, i, 1)]) AS n FROM p WHERE b IS NOT NULL""")
def differing_positions(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_name").alias("a"))
    pairs = graphs.ahead(parts, "p_brand", "p_partkey", F.col("a"), F.expr("p_partkey div 10000")).select("p_partkey", "a", F.col("ahead").alias("b")).where("b is not null")
    return pairs.select("p_partkey", fs.differing_positions("a", "b").alias("n"))


@query("run_blocks", """
WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
x AS (SELECT p_partkey, i FROM (SELECT p_partkey, a, b, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM p WHERE b IS NOT NULL) WHERE substr(a, i, 1) <> substr(b, i, 1)),
y AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM x)
SELECT p_partkey, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM y GROUP BY p_partkey, g""")
def run_blocks(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, d, "part").select("p_partkey", F.split("p_name", "").alias("a"), F.split(F.lead("p_name").over(w), "").alias("b")).where("b is not null")
    letters = pairs.select("p_partkey", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).where("z.a is not null and z.b is not null and z.a <> z.b and z.a <> '' and z.b <> ''")
    return graphs.run_blocks(letters.select("p_partkey", (F.col("i") + 1).cast("long").alias("pos")), "p_partkey", "pos")


@query("spelled_walks", f"""
WITH w AS (SELECT user_id, u, v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM (SELECT user_id, ts, event_id, substr(event_type, 1, 1) AS u, coalesce(lead(substr(event_type, 1, 1)) OVER w, first_value(substr(event_type, 1, 1)) OVER w) AS v FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
SELECT user_id, string_agg(u, '' ORDER BY i) AS word FROM w GROUP BY 1""")
def spelled_walks(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    letter = F.substring("event_type", 1, 1)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", letter.alias("u"))
    first = F.first("u").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    arcs = e.select("user_id", F.row_number().over(w).alias("i"), F.concat("u", F.coalesce(F.lead("u").over(w), first)).alias("arc"))
    grouped = arcs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "arc"))).alias("a"))
    return grouped.select("user_id", fs.spell(F.col("a.arc"), 1).alias("word"))


@query("log_factorials", "SELECT user_id, round(sum(l), 6) AS log10_multiplicity FROM (SELECT user_id, event_type, (SELECT coalesce(sum(log10(x)), 0) FROM range(1, n + 1) r(x)) AS l FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def log_factorials(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.round(F.sum(fs.log10_factorial("n")), 6).alias("log10_multiplicity"))


@query("permutation_signs", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2), p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY e) AS i, event_type AS x FROM f)
SELECT a.user_id, CAST(CASE WHEN sum(CASE WHEN a.i < b.i AND a.x > b.x THEN 1 ELSE 0 END) % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS sign FROM p a JOIN p b ON a.user_id = b.user_id GROUP BY 1""")
def permutation_signs(spark, d):
    f = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    order = f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("e", "event_type"))).alias("a"))
    return order.select("user_id", fs.permutation_sign(F.col("a.event_type")).alias("sign"))


@query("residue_sums", f"SELECT user_id, {BIG('sum(event_id * event_id) % 2147483647')} AS r0, {BIG('sum(event_id * event_id) % 2147483629')} AS r1 FROM events GROUP BY 1")
def residue_sums(spark, d):
    square = F.col("event_id") * F.col("event_id")
    residue = lambda p: (F.sum(square % p) % p)
    return table(spark, d, "events").groupBy("user_id").agg(residue(2147483647).alias("r0"), residue(2147483629).alias("r1"))


# ---------------------------------------------------------------- graphs


@query("walk_multigraph", ARCS)
def walk_multigraph(spark, d):
    return walks(spark, d)


@query("walk_degrees", f"SELECT graph_id, x AS v, {BIG('sum(i)')} AS indegree, {BIG('sum(o)')} AS outdegree FROM (SELECT graph_id, u AS x, m AS o, 0 AS i FROM ({ARCS}) UNION ALL SELECT graph_id, v, 0, m FROM ({ARCS})) GROUP BY 1, 2")
def walk_degrees(spark, d):
    return graphs.degrees(walks(spark, d))


@query("walk_balance", f"SELECT graph_id, count(*) AS vertices, bool_and(o = i) AS balanced FROM (SELECT graph_id, x, sum(o) AS o, sum(i) AS i FROM (SELECT graph_id, u AS x, m AS o, 0 AS i FROM ({ARCS}) UNION ALL SELECT graph_id, v, 0, m FROM ({ARCS})) GROUP BY 1, 2) GROUP BY 1")
def walk_balance(spark, d):
    return graphs.balance(walks(spark, d))


@query("walk_branch_degrees", f"SELECT graph_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS degrees FROM (SELECT graph_id, u, sum(m) AS o FROM ({ARCS}) GROUP BY 1, 2) WHERE o > 1 GROUP BY 1")
def walk_branch_degrees(spark, d):
    return graphs.branch_degrees(walks(spark, d))


@query("walk_laplacian", f"SELECT graph_id, i, j, {BIG('sum(x)')} AS value FROM (SELECT graph_id, u AS i, v AS j, -m AS x FROM ({ARCS}) WHERE u <> v UNION ALL SELECT graph_id, u, u, m FROM ({ARCS}) WHERE u <> v) GROUP BY 1, 2, 3 HAVING sum(x) <> 0")
def walk_laplacian(spark, d):
    return graphs.laplacian(walks(spark, d))


@query("walk_line_digraph", f"WITH a AS ({ARCS}) SELECT p.graph_id, p.u || '>' || p.v AS u, q.u || '>' || q.v AS v, {BIG('p.m * q.m')} AS m FROM a p JOIN a q ON p.graph_id = q.graph_id AND p.v = q.u")
def walk_line_digraph(spark, d):
    return graphs.line_digraph(walks(spark, d))


_TYPES = ("click", "error", "purchase", "signup", "view")


def _tree_sql(size: int = 4) -> str:
    """Reduced Laplacian determinant of a five-vertex graph as an explicit sum over permutations."""
    names = _TYPES[1:]
    cell = lambda i, j: f"d{i}" if i == j else f"(-a{i}{j})"
    terms = []
    for p in permutations(range(size)):
        odd = sum(p[i] > p[j] for i in range(size) for j in range(i + 1, size)) % 2
        terms.append(("-" if odd else "+") + "*".join(cell(i, p[i]) for i in range(size)))
    off = ", ".join(f"CAST(coalesce(sum(CASE WHEN u = '{names[i]}' AND v = '{names[j]}' THEN m END), 0) AS HUGEINT) AS a{i}{j}" for i in range(size) for j in range(size) if i != j)
    diagonal = ", ".join(f"CAST(sum(CASE WHEN u = '{names[i]}' AND v <> u THEN m ELSE 0 END) AS HUGEINT) AS d{i}" for i in range(size))
    return f"SELECT graph_id, CAST({' '.join(terms)} AS VARCHAR) AS trees FROM (SELECT graph_id, {off}, {diagonal} FROM ({ARCS}) GROUP BY 1)"


@query("walk_tree_count", _tree_sql())
def walk_tree_count(spark, d):
    return counting.graph_invariants(walks(spark, d)).select("graph_id", "trees")


@query("walk_invariants")
def walk_invariants(spark, d):
    return counting.graph_invariants(walks(spark, d))


@query("chord_crossings", """
WITH p AS (SELECT user_id, event_type || '/' || CAST(hour(ts) AS VARCHAR) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, x, min(i) AS p1, max(i) AS p2 FROM p GROUP BY 1, 2 HAVING count(*) = 2)
SELECT a.user_id, a.x AS a, b.x AS b FROM c a JOIN c b ON a.user_id = b.user_id AND a.x < b.x
WHERE (a.p1 < b.p1 AND b.p1 < a.p2) <> (a.p1 < b.p2 AND b.p2 < a.p2)""")
def chord_crossings(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.concat("event_type", F.lit("/"), F.hour("ts").cast("string")).alias("x"), F.row_number().over(w).alias("i"))
    return graphs.chord_crossings(e, "user_id", "x", "i")


@query("components", """
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS u, 'n' || c_nationkey AS v FROM customer), l AS (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e), n AS (SELECT DISTINCT x FROM l),
r AS (SELECT x AS o, x AS z FROM n UNION SELECT r.o, l.y FROM r JOIN l ON l.x = r.z)
SELECT o AS node, min(z) AS component FROM r GROUP BY 1""")
def components(spark, d):
    """Customers and their nations."""
    customer = table(spark, d, "customer")
    return graphs.components(customer.select(F.concat(F.lit("c"), "c_custkey").alias("u"), F.concat(F.lit("n"), "c_nationkey").alias("v")))


@query("order_part_components", """
WITH RECURSIVE e AS MATERIALIZED (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
l(v, c) USING KEY (v) AS (SELECT DISTINCT a, a FROM s
  UNION SELECT s.b, min(n.c) FROM l n JOIN s ON s.a = n.v JOIN recurring.l o ON o.v = s.b WHERE n.c < o.c GROUP BY s.b)
SELECT v AS node, c AS component FROM l""")
def order_part_components(spark, d):
    """Orders and parts joined by line items (no SQL: the recursion would list all pairs of one large component)."""
    line = table(spark, d, "lineitem")
    return graphs.components(line.select(F.concat(F.lit("o"), "l_orderkey").alias("u"), F.concat(F.lit("p"), "l_partkey").alias("v")))


HIERARCHY = """SELECT 'r' || r_regionkey AS u, 'n' || n_nationkey AS v, 1 AS m FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'root', 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 's' || o_orderstatus, count(*) FROM orders GROUP BY 1, 2"""


@query("dag_path_counts", f"""
WITH RECURSIVE a AS ({HIERARCHY}), p AS (SELECT 'root' AS node, CAST(1 AS HUGEINT) AS n, 0 AS depth UNION ALL SELECT v, n * m, depth + 1 FROM p JOIN a ON a.u = p.node)
SELECT node, {BIG('sum(n)')} AS paths FROM p GROUP BY 1""")
def dag_path_counts(spark, d):
    one = F.lit(1).cast("long").alias("m")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, customer, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    arcs = nation.select(key("r", "n_regionkey").alias("u"), key("n", "n_nationkey").alias("v"), one)
    arcs = arcs.unionByName(region.select(F.lit("root").alias("u"), key("r", "r_regionkey").alias("v"), one))
    arcs = arcs.unionByName(customer.select(key("n", "c_nationkey").alias("u"), key("c", "c_custkey").alias("v"), one))
    arcs = arcs.unionByName(orders.groupBy(key("c", "o_custkey").alias("u"), key("s", "o_orderstatus").alias("v")).agg(F.count("*").alias("m")))
    return graphs.path_counts(arcs, "root")


@query("bundle_steps", f"""
WITH o AS (SELECT graph_id, u, min(v) AS v, max(v) AS w, sum(m) AS r FROM ({ARCS}) GROUP BY 1, 2)
SELECT a.graph_id, a.u, a.v, {BIG('a.r')} AS r FROM o a JOIN o b ON a.graph_id = b.graph_id AND a.v = b.u AND a.r = b.r WHERE a.v = a.w AND a.u <> a.v AND a.r > 1""")
def bundle_steps(spark, d):
    return graphs.bundle_steps(walks(spark, d))


@published("complete_de_bruijn", "SELECT CAST(0 AS BIGINT) AS graph_id, CAST(w AS VARCHAR) AS u, CAST((w * 4 + c) % 4096 AS VARCHAR) AS v, CAST(1 AS BIGINT) AS m FROM range(4096) x(w), range(4) y(c)")
def complete_de_bruijn(spark, d):
    return graphs.complete_de_bruijn(spark, 4, 6)


@published("eulerian_orientations", """
WITH e(i, a, b) AS (VALUES (0, 0, 1), (1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 2, 3), (5, 2, 3), (6, 3, 0), (7, 3, 0)),
o AS (SELECT mask, x, sum(s) AS net FROM (SELECT mask, CASE WHEN (mask >> i) & 1 = 1 THEN b ELSE a END AS x, 1 AS s FROM range(256) r(mask), e
      UNION ALL SELECT mask, CASE WHEN (mask >> i) & 1 = 1 THEN a ELSE b END, -1 FROM range(256) r(mask), e) GROUP BY 1, 2)
SELECT CAST(mask AS BIGINT) AS mask FROM o GROUP BY 1 HAVING bool_and(net = 0)""")
def eulerian_orientations(spark, d):
    """Balanced orientations of the doubled four-cycle, as bit masks over its eight edges."""
    edges = spark.createDataFrame([(i, i // 2, (i // 2 + 1) % 4) for i in range(8)], "i int, a int, b int")
    # both sides are fixed: 2^8 masks and 8 edges
    turned = spark.range(256).join(F.broadcast(edges)).withColumn("bit", F.expr("shiftright(id, i) & 1"))
    start, end = F.when(F.col("bit") == 1, F.col("b")).otherwise(F.col("a")), F.when(F.col("bit") == 1, F.col("a")).otherwise(F.col("b"))
    ends = turned.select("id", start.alias("x"), F.lit(1).alias("s")).unionByName(turned.select("id", end.alias("x"), F.lit(-1).alias("s")))
    return ends.groupBy("id", "x").agg(F.sum("s").alias("net")).groupBy("id").agg(F.bool_and(F.col("net") == 0).alias("ok")).where("ok").select(F.col("id").alias("mask"))


# ---------------------------------------------------------------- intervals, order, sets


@query("gap_clusters", """
WITH e AS (SELECT user_id, event_id, event_type, CAST(epoch(ts) AS BIGINT) AS lo, CAST(epoch(ts) AS BIGINT) + 600 AS hi FROM events),
t AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS turns FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY lo, hi) <> event_type THEN 1 ELSE 0 END AS turn FROM e)),
n AS (SELECT *, CASE WHEN reach IS NULL OR lo - reach > 20000 THEN 1 ELSE 0 END AS new FROM (SELECT *, max(hi) OVER (PARTITION BY user_id, turns ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t))
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS cluster FROM n""")
def gap_clusters(spark, d):
    second = F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", second.alias("lo"))
    return graphs.gap_clusters(e.withColumn("hi", F.col("lo") + 600), "user_id", "lo", "hi", 20000, "event_type", ("event_id",)).select("user_id", "event_id", "cluster")


@query("interval_overlaps", """
WITH o AS (SELECT o_orderkey AS a_id, o_custkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS lo, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 AS hi FROM orders)
SELECT x.a_id, y.a_id AS b_id FROM o x JOIN o y ON x.k = y.k AND x.lo <= y.hi AND y.lo <= x.hi AND x.a_id < y.a_id""")
def interval_overlaps(spark, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a_id"), days.alias("a_lo"), (days + 30).alias("a_hi"))
    other = o.select("k", F.col("a_id").alias("b_id"), F.col("a_lo").alias("b_lo"), F.col("a_hi").alias("b_hi"))
    return graphs.overlapping(o, other, 64, "k").where("a_id < b_id").select("a_id", "b_id")


@query("upper_medians", "SELECT lang, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def upper_medians(spark, d):
    return graphs.upper_median(table(spark, d, "documents"), "lang", "n_chars")


@query("top_families", "SELECT source, count(*) AS n, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY 1 HAVING count(*) >= 8 ORDER BY longest DESC, source LIMIT 20")
def top_families(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    return g.where("n >= 8").orderBy(F.desc("longest"), "source").limit(20)


@query("vertex_ids", f"SELECT seq_id, kmer, CAST(dense_rank() OVER (PARTITION BY seq_id ORDER BY kmer) - 1 AS INTEGER) AS vertex FROM (SELECT seq_id, kmer FROM ({circular(SEQS, 14)}) GROUP BY 1, 2 HAVING count(*) > 1)")
def vertex_ids(spark, d):
    occ = words.occurrences(dna(spark, d), 14, repeated=True).select("seq_id", "kmer").distinct()
    return occ.withColumn("vertex", F.dense_rank().over(Window.partitionBy("seq_id").orderBy("kmer")) - 1)


@query("spectrum_difference", f"SELECT kmer FROM (SELECT DISTINCT kmer FROM ({circular(SEQS + " WHERE lang = 'en'", 7)}) EXCEPT SELECT DISTINCT kmer FROM ({circular(SEQS + " WHERE lang = 'de'", 7)}))")
def spectrum_difference(spark, d):
    s = dna(spark, d)
    kmers = lambda lang: words.word_counts(s.where(F.col("lang") == lang), 7, circular=True).select("kmer")
    return kmers("en").exceptAll(kmers("de"))


@query("strain_subsets", """
WITH m AS (SELECT DISTINCT l_partkey AS item, l_linestatus || l_returnflag AS s FROM lineitem),
t AS (SELECT item, [s] AS x FROM m UNION ALL SELECT a.item, [a.s, b.s] FROM m a JOIN m b ON a.item = b.item AND a.s < b.s
      UNION ALL SELECT a.item, [a.s, b.s, c.s] FROM m a JOIN m b ON a.item = b.item AND a.s < b.s JOIN m c ON c.item = b.item AND b.s < c.s)
SELECT array_to_string(x, ',') AS subset, count(*) AS items FROM t GROUP BY 1""")
def strain_subsets(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.concat("l_linestatus", "l_returnflag").alias("strain"))
    return pools.strain_subsets(line)


@query("complement_pairs", """
WITH c AS (SELECT o_custkey, [CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT)] AS p FROM orders GROUP BY 1)
SELECT a.o_custkey AS a, b.o_custkey AS b FROM c a JOIN c b ON b.p = [4 - a.p[1], 5 - a.p[2], 6 - a.p[3]] AND a.o_custkey < b.o_custkey""")
def complement_pairs(spark, d):
    """Pairs of customers whose order-status vectors add up to (4, 5, 6): an equi-join on the complement."""
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.array(n("F"), n("O"), n("P")).alias("p"))
    rest = c.select(F.col("o_custkey").alias("a"), F.zip_with(F.array(F.lit(4), F.lit(5), F.lit(6)), "p", lambda m, x: m - x).cast("array<bigint>").alias("p"))
    return rest.join(c.select(F.col("o_custkey").alias("b"), "p"), "p").where("a < b").select("a", "b")


# ---------------------------------------------------------------- encoders


@query("regex_motifs", "SELECT doc_id AS seq_id, CAST(len(regexp_extract_all(text, '[Cc].{2,4}[Cc].{12}[Hh].{3,5}[Hh]')) AS BIGINT) AS matches FROM documents")
def regex_motifs(spark, d):
    return pools.motif_matches(table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq")), "[Cc].{2,4}[Cc].{12}[Hh].{3,5}[Hh]")


_FILTERS = {0: {(0, "s"): 3, (1, "r"): 2, (2, "i"): -1, (1, "#"): 4}, 1: {(0, "b"): 2, (2, "d"): 5, (1, "^"): 1, (2, "$"): 1}}
_BIAS = {0: -1, 1: 0}


def _pool_sql() -> str:
    w = ", ".join(f"({f}, {o}, '{c}', {x})" for f, cells in _FILTERS.items() for (o, c), x in cells.items())
    b = ", ".join(f"({f}, {x})" for f, x in _BIAS.items())
    return f"""
WITH t AS (SELECT p_partkey AS seq_id, '^^' || p_name || p_brand || '$$' AS s FROM part), q AS (SELECT seq_id, i, substr(s, i, 3) AS k FROM (SELECT seq_id, s, unnest(range(1, length(s) - 1)) AS i FROM t)),
w(f, o, c, x) AS (VALUES {w}), b(f, bias) AS (VALUES {b}),
z AS (SELECT q.seq_id, q.i, b.f, greatest(0, b.bias + coalesce((SELECT sum(w.x) FROM w WHERE w.f = b.f AND substr(q.k, w.o + 1, 1) = w.c), 0)) AS y FROM q, b)
SELECT seq_id, CAST(f AS INTEGER) AS filter, CAST(sum(y) AS BIGINT) AS total, count(*) AS windows FROM z GROUP BY 1, 2"""


@query("cnn_mean_pool", _pool_sql())
def cnn_mean_pool(spark, d):
    part = dealt(table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.concat("p_name", "p_brand").alias("seq")))
    weights = spark.createDataFrame([(f, o, c, x) for f, cells in _FILTERS.items() for (o, c), x in cells.items()], "filter int, offset int, letter string, weight long")
    return pools.mean_pool(part, weights, spark.createDataFrame(list(_BIAS.items()), "filter int, bias long"), 3)


# ---------------------------------------------------------------- kernels on literals and on tables


_LITERALS = [("ACACCAAAACCA", 2), ("CCAACAACCAAC", 3), ("CACCAAACCACA", 3), ("CACCCCCAACCA", 2), ("ACCCCAAACACC", 2), ("CCCACAAACAAC", 2)]


@published("critical_groups", "SELECT * FROM (VALUES ('ACACCAAAACCA', '12', '288'), ('CCAACAACCAAC', '12', '48'), ('CACCAAACCACA', '4', '8'), ('CACCCCCAACCA', '6', '576'), ('ACCCCAAACACC', '6', '144'), ('CCCACAAACAAC', '6', '96')) t(graph_id, trees, circuits)")
def critical_groups(spark, d):
    arcs = generators.arc_table(spark, {s: counting.circular_graph(s, k) for s, k in _LITERALS})
    return counting.graph_invariants(arcs).select("graph_id", "trees", "circuits")


@published("nerve_homology", "SELECT * FROM (VALUES ('sphere', '0'), ('torus', 'Z^2'), ('projective plane', 'Z/2')) t(surface, h1)")
def nerve_homology(spark, d):
    from strandweave.operators import exact

    surfaces = {"sphere": generators.OCTAHEDRON, "torus": generators.TORUS, "projective plane": generators.PROJECTIVE_PLANE}
    rows = spark.createDataFrame([(n, [list(t) for t in s]) for n, s in surfaces.items()], "surface string, triangles array<array<int>>")

    def run(batches):
        for pdf in batches:
            pdf["h1"] = [exact.group_name(*pools.nerve_homology(pools.surface_pool([tuple(int(x) for x in t) for t in s]))) for s in pdf["triangles"]]
            yield pdf[["surface", "h1"]]

    return rows.mapInPandas(run, "surface string, h1 string")


@query("fibre_sizes", """
WITH c AS (SELECT p_partkey AS seq_id, p_name AS s FROM part),
l AS (SELECT seq_id, s, substr(s, i, 1) AS x FROM (SELECT seq_id, s, unnest(range(1, length(s) + 1)) AS i FROM c)),
m AS (SELECT seq_id, s, x, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT seq_id, CAST(1 AS INTEGER) AS k, CAST(CAST(factorial(CAST(length(s) AS INTEGER)) / product(factorial(CAST(n AS INTEGER))) AS HUGEINT) AS VARCHAR) AS fibre FROM m GROUP BY seq_id, s""")
def fibre_sizes(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq"))
    return counting.fibres(names, (1,)).select("seq_id", "k", "fibre")


@query("spectral_resolution")
def spectral_resolution(spark, d):
    """Word length from which each customer name, brand and type of a part is alone in its fibre."""
    part = dealt(table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.concat("p_name", "p_brand", "p_type").alias("seq")))
    return counting.resolutions(part)


@query("cover_counts")
def cover_counts(spark, d):
    """Lattice counts of the double covers of part names as circular sequences, four-letter words."""
    part = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select(F.col("p_partkey").alias("seq_id"), fs.pseudo_dna(F.concat("p_name", "p_brand", "p_type")).alias("seq"))
    return counting.cover_counts(part, 4, cap=2000)


from strandweave.plans import checks, files, kernels, large, streams  # noqa: E402,F401  (add their queries)
