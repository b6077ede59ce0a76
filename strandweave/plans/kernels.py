"""Queries of the exact kernels: on tables where SQL can follow, on literals with published or closed-form values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import sequences as fs
from strandweave.operators import complexes, counting, exact, graphs, moves, pools, words
from strandweave.plans import registry as r
from strandweave.session import shared_dir
from strandweave.sources import generators as gen
from strandweave.streaming import spectra


def literals(spark: SparkSession, rows: list[tuple], schema: str, function, out: str) -> DataFrame:
    """Rows of a literal table with the columns that ``function(*row)`` adds, computed by a task each."""
    df = spark.createDataFrame(rows, schema).repartition(len(rows))
    names = df.columns
    fields = [c.strip().split()[0] for c in out.split(",")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            done = [(*row, *function(*row)) for row in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(done, columns=[*names, *fields])

    return df.mapInPandas(run, f"{schema}, {out}")


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)}) t({columns})"


# ---------------------------------------------------------------- numbers and matrices


@r.query("elementary_divisors", """
WITH p AS (SELECT x AS p FROM range(2, 15001) t(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 123) d(y) WHERE y * y <= x AND x % y = 0)),
q AS (SELECT c_custkey AS n, p, max(TRY_CAST(pow(p, e) AS BIGINT)) AS q FROM customer, p, range(1, 15) r(e) WHERE p <= c_custkey AND c_custkey % p = 0 AND pow(p, e) <= c_custkey AND c_custkey % TRY_CAST(pow(p, e) AS BIGINT) = 0 GROUP BY 1, 2)
SELECT n, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS divisors FROM q GROUP BY 1""")
def elementary_divisors(spark, d):
    """Prime powers of the cyclic group Z/n for every customer number n above 1."""
    n = r.table(spark, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("n"))

    def run(batches):
        for pdf in batches:
            pdf["divisors"] = [",".join(map(str, exact.elementary([int(x)]))) for x in pdf["n"]]
            yield pdf

    return n.mapInPandas(run, "n long, divisors string")


@r.query("crt_round_trip", "SELECT event_id, CAST(CAST(event_id AS HUGEINT) * event_id * event_id * event_id AS VARCHAR) AS value FROM events")
def crt_round_trip(spark, d):
    """Fourth powers put together from residues modulo three primes below 2^31."""
    primes = exact.primes_below(2**31, 3)
    residue = lambda p: ((F.col("event_id") * F.col("event_id")) % p) * ((F.col("event_id") * F.col("event_id")) % p) % p
    e = r.table(spark, d, "events").select("event_id", *[residue(p).alias(f"r{i}") for i, p in enumerate(primes)])

    def run(batches):
        for pdf in batches:
            pdf["value"] = [str(exact.residues_to_integer([int(x) for x in row], primes)) for row in pdf[["r0", "r1", "r2"]].itertuples(index=False)]
            yield pdf[["event_id", "value"]]

    return e.mapInPandas(run, "event_id long, value string")


_CELL = "CAST(sum(CASE WHEN event_type = '{0}' THEN 1 ELSE 0 END) AS BIGINT) AS {1}".format
_CELLS = ", ".join(_CELL(t, c) for t, c in zip(("click", "error", "purchase", "signup"), "abcd"))


@r.query("matrix_determinants", f"""
SELECT user_id AS matrix_id, CAST(a * d - b * c AS VARCHAR) AS determinant, CAST(CASE WHEN a * d <> b * c THEN 2 WHEN a <> 0 OR b <> 0 OR c <> 0 OR d <> 0 THEN 1 ELSE 0 END AS INTEGER) AS rank,
       CAST(abs(a * d - b * c) // gcd(gcd(a, b), gcd(c, d)) AS VARCHAR) AS largest_factor FROM (SELECT user_id, {_CELLS} FROM events GROUP BY 1)""")
def matrix_determinants(spark, d):
    """Determinant, rank and largest invariant factor of each user's 2 x 2 matrix of event counts."""
    at = F.create_map(*[F.lit(x) for t, i in (("click", 0), ("error", 1), ("purchase", 2), ("signup", 3)) for x in (t, i)])
    e = r.table(spark, d, "events").where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.count("*").alias("value"))
    cells = e.select(F.col("user_id").alias("matrix_id"), (at[F.col("event_type")] / 2).cast("int").alias("i"), (at[F.col("event_type")] % 2).alias("j"), "value")

    def run(key, pdf):
        import pandas as pd

        rows = [[0, 0], [0, 0]]
        for i, j, x in zip(pdf["i"], pdf["j"], pdf["value"]):
            rows[int(i)][int(j)] = int(x)
        divisors, free = exact.cokernel(rows)
        factors = exact.invariant_factors(divisors)
        largest = 0 if free else (factors or [1])[-1]
        return pd.DataFrame([(key[0], str(exact.determinant(rows)), exact.rank_mod(rows), str(largest))], columns=["matrix_id", "determinant", "rank", "largest_factor"])

    return cells.groupBy("matrix_id").applyInPandas(run, "matrix_id long, determinant string, rank int, largest_factor string")


@r.query("walk_trees_by_elimination", r._tree_sql())
def walk_trees_by_elimination(spark, d):
    """The tree counts again, by sparse elimination in least-degree order instead of a dense determinant."""

    def run(key, pdf):
        import pandas as pd

        g = counting._arc_counter(pdf)
        rows = counting.reduced_laplacian(g)
        cells = {(i, j): x for i, row in enumerate(rows) for j, x in enumerate(row) if x}
        return pd.DataFrame([(key[0], str(exact.determinant_by_order(cells, len(rows))[0]))], columns=["graph_id", "trees"])

    return r.walks(spark, d).groupBy("graph_id").applyInPandas(run, "graph_id long, trees string")


@r.query("walk_circuit_logs", f"""
WITH t AS ({r._tree_sql()}), o AS (SELECT graph_id, u, sum(m) AS d FROM ({r.ARCS}) GROUP BY 1, 2),
l AS (SELECT graph_id, sum((SELECT coalesce(sum(log10(x)), 0) FROM range(1, CAST(d AS BIGINT)) q(x))) AS s FROM o GROUP BY 1)
SELECT t.graph_id, round(log10(CAST(trees AS DOUBLE)) + s, 6) AS log10_circuits FROM t JOIN l USING (graph_id)""")
def walk_circuit_logs(spark, d):
    """log10 of the number of arc-rooted Eulerian circuits of each walk."""
    inv = counting.graph_invariants(r.walks(spark, d)).select("graph_id", "circuits")
    digits = F.length("circuits")
    lead = F.expr("double(left(circuits, 15))")
    return inv.select("graph_id", F.round(F.log10(lead) + F.greatest(digits - 15, F.lit(0)), 6).alias("log10_circuits"))


# ---------------------------------------------------------------- graphs


@r.query("signed_balance", """
WITH RECURSIVE g AS (SELECT c_nationkey AS graph_id, 'c' || c_custkey AS u, c_mktsegment AS v, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS sign FROM customer
  UNION ALL SELECT c_nationkey, 'c' || c_custkey, 'hub', 1 FROM customer),
l AS (SELECT graph_id, u || s AS x, v || (s * sign) AS y FROM g, (VALUES (1), (-1)) w(s)), b AS (SELECT graph_id, x, y FROM l UNION SELECT graph_id, y, x FROM l),
n AS (SELECT DISTINCT graph_id, x FROM b), c AS (SELECT graph_id, x AS o, x AS z FROM n UNION SELECT c.graph_id, c.o, b.y FROM c JOIN b ON b.graph_id = c.graph_id AND b.x = c.z)
SELECT graph_id, NOT bool_or(o LIKE '%-1' AND z = left(o, length(o) - 2) || '1') AS balanced FROM c GROUP BY 1""")
def signed_balance(spark, d):
    """Whether each nation's graph of customers, segments and a hub is balanced, debts being negative."""
    c = r.table(spark, d, "customer").select(F.col("c_nationkey").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("u"), F.col("c_mktsegment").alias("v"), F.when(F.col("c_acctbal") < 0, -1).otherwise(1).alias("sign"))
    return graphs.signed_balance(c.unionByName(c.withColumn("v", F.lit("hub")).withColumn("sign", F.lit(1))))


@r.query("graph_components", """
WITH RECURSIVE g AS (SELECT c_mktsegment AS graph_id, 'c' || c_custkey AS u, 'n' || c_nationkey AS v FROM customer),
b AS (SELECT graph_id, u AS x, v AS y FROM g UNION SELECT graph_id, v, u FROM g), n AS (SELECT DISTINCT graph_id, x FROM b),
c AS (SELECT graph_id, x AS o, x AS z FROM n UNION SELECT c.graph_id, c.o, b.y FROM c JOIN b ON b.graph_id = c.graph_id AND b.x = c.z)
SELECT graph_id, count(DISTINCT m) AS components FROM (SELECT graph_id, o, min(z) AS m FROM c GROUP BY 1, 2) GROUP BY 1""")
def graph_components(spark, d):
    """Number of components of the customer-nation graph of each market segment."""
    c = r.table(spark, d, "customer")
    return graphs.connected(c.select(F.col("c_mktsegment").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("u"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("v")))


_NAMES = "SELECT p_partkey AS seq_id, p_name AS s FROM part"
_GRAM = f"SELECT seq_id AS graph_id, kmer AS u, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS v FROM ({r.circular(_NAMES, 2)}) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@r.query("unitigs", f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT graph_id, u, v, count(*) AS m FROM ({_GRAM}) GROUP BY 1, 2, 3),
g AS (SELECT graph_id, x, sum(o) AS o, sum(i) AS i FROM (SELECT graph_id, u AS x, m AS o, 0 AS i FROM a UNION ALL SELECT graph_id, v, 0, m FROM a) GROUP BY 1, 2),
n AS MATERIALIZED (SELECT graph_id, x FROM g WHERE o = 1 AND i = 1),
w AS (SELECT a.graph_id, a.u, a.v, a.m FROM a LEFT JOIN n ON n.graph_id = a.graph_id AND n.x = a.u WHERE n.x IS NULL
      UNION ALL SELECT w.graph_id, w.u, a.v, w.m FROM w JOIN n ON n.graph_id = w.graph_id AND n.x = w.v JOIN a ON a.graph_id = w.graph_id AND a.u = w.v)
SELECT w.graph_id, w.u, w.v, CAST(sum(w.m) AS BIGINT) AS m FROM w LEFT JOIN n ON n.graph_id = w.graph_id AND n.x = w.v WHERE n.x IS NULL GROUP BY 1, 2, 3""")
def unitigs(spark, d):
    """Unitig contraction of the two-letter word graph of each part name."""
    part = r.dealt(r.table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq")))
    return graphs.unitigs(words.word_arcs(part, 2))


_CHAINS = [("A", 2), ("B", 3), ("C", 5)]


@r.published("bundle_chains", values([(n, 6, s, 3) for n, s in _CHAINS], "graph_id, vertices, s, r").replace("SELECT *", "SELECT graph_id, s, r"))
def bundle_chains(spark, d):
    """Chains planted in a small Eulerian graph are found with their lengths and degrees."""
    made = {}
    for name, s in _CHAINS:
        # a cycle of degree-two vertices with one vertex of degree three
        base = counting.Counter({("0", "1"): 2, ("1", "0"): 1, ("1", "2"): 2, ("2", "0"): 1, ("2", "1"): 1, ("0", "0"): 1})
        made[name] = gen.planted_chain(base, "0", 3, s)
    _, chains = graphs.bundle_contract(gen.arc_table(spark, made))
    return chains.where("r = 3 and head like '0.%'").select("graph_id", "s", "r")


# ---------------------------------------------------------------- counts on literals


_WORD_GROUPS = [("AABBCC", "0"), ("AABCBC", "Z/2"), ("ABACBC", "Z/3"), ("ABCABC", "(Z/2)^2"), ("AABACCBBC", "Z/3"), ("AABABCBCC", "Z/4"), ("abcdefacbdfe", "Z/2 + (Z/3)^2"), ("abcfedacbefd", "Z/2 + Z/9")]


@r.published("word_groups", values(_WORD_GROUPS, "word, repeat_group"))
def word_groups(spark, d):
    """Critical groups of the connector digraphs of repeat words."""
    return literals(spark, [(w,) for w, _ in _WORD_GROUPS], "word string", lambda w: (exact.group_name(counting.critical_group(counting.connector_digraph(w))),), "repeat_group string")


@r.published("group_census", values([(3, 16), (4, 318)], "letters, words"))
def group_census(spark, d):
    """Cyclic words of n letters twice each (by Burnside: (2n)! / 2^n / 2n and the half-turn words), over all their groups."""

    def run(n):
        census = counting.group_census(dict.fromkeys("ABCD"[:n], 2))
        return (sum(len(w) for w in census.values()),)

    return literals(spark, [(3,), (4,)], "letters long", run, "words long")


_COLLAPSE = [("AACAC", 3, 3), ("AACACC", 2, 3), ("AAAA", 3, 1)]


@r.published("collapse_widths", values(_COLLAPSE, "word, longest_repeat, width"))
def collapse_widths(spark, d):
    return literals(spark, [(w,) for w, *_ in _COLLAPSE], "word string", lambda w: (counting.longest_repeat(w), counting.collapse_width(w)), "longest_repeat long, width long")


@r.published("brute_force_circuits", values([("ACACCAAAACCA", 288), ("CCAACAACCAAC", 48), ("CACCAAACCACA", 8), ("CACCCCCAACCA", 576), ("ACCCCAAACACC", 144), ("CCCACAAACAAC", 96)], "word, circuits"))
def brute_force_circuits(spark, d):
    return literals(spark, [(w, k) for w, k in r._LITERALS], "word string, k long", lambda w, k: (len(counting.circuits(counting.circular_graph(w, k))),), "circuits long").select("word", "circuits")


@r.published("rotor_orbits", values([("ACACCAAAACCA", 12, 12), ("CCAACAACCAAC", 12, 12), ("CACCAAACCACA", 4, 4), ("CACCCCCAACCA", 6, 6), ("ACCCCAAACACC", 6, 6), ("CCCACAAACAAC", 6, 6)], "word, trees, orbit"))
def rotor_orbits(spark, d):
    """Arborescences by enumeration, and the orbit of one of them under rotor routing: the same set."""

    def run(w, k):
        g = counting.circular_graph(w, k)
        root = counting.vertices(g)[0]
        trees = moves.tree_rotors(g, root)
        return len(trees), len(moves.orbit_of(g, root, trees[0]))

    return literals(spark, r._LITERALS, "word string, k long", run, "trees long, orbit long").select("word", "trees", "orbit")


_WORDS = ["ACGTAC", "AACATT", "CATGCA", "AATTAA", "ACACGT", "GATTAC"]


def _reconstruction_sql(k: int = 3, n: int = 6) -> str:
    """Every word of n letters with the two-strand k-word counts of each literal, by exhaustion; cyclic words count once."""
    given = ", ".join(f"('{w}')" for w in _WORDS)
    letters = " || ".join(f"substr('ACGT', (x // {4**i}) % 4 + 1, 1)" for i in range(n))
    spectrum = lambda source: f"SELECT w, string_agg(kmer, ',' ORDER BY kmer) AS key FROM (SELECT w, substr(c, i, {k}) AS kmer FROM (SELECT w, w || substr(w, 1, {k - 1}) AS c, unnest(range(1, {n + 1})) AS i FROM ({source})) UNION ALL SELECT w, {r.RC(f'substr(c, i, {k})')} FROM (SELECT w, w || substr(w, 1, {k - 1}) AS c, unnest(range(1, {n + 1})) AS i FROM ({source}))) GROUP BY 1"
    rotations = ", ".join(f"substr(w, {i}) || substr(w, 1, {i - 1})" for i in range(1, n + 1))
    return f"""
WITH a AS (SELECT {letters} AS w FROM range({4**n}) t(x)), s AS ({spectrum('SELECT w FROM a')}), g AS ({spectrum(f'SELECT w FROM (VALUES {given}) v(w)')})
SELECT g.w AS word, count(DISTINCT least({rotations.replace('(w,', '(s.w,')})) AS reconstructions FROM g JOIN s ON s.key = g.key GROUP BY 1"""


@r.published("reconstruction_closures", _reconstruction_sql())
def reconstruction_closures(spark, d):
    """Words reached from each literal by transpositions, inversions and strand reversal, as a fixpoint."""
    words = spark.createDataFrame([(w, w) for w in _WORDS], "seq_id string, seq string")
    return moves.closures(words, 2).groupBy(F.col("seq_id").alias("word")).agg(F.count("*").alias("reconstructions"))


_SNPS = [1, 2, 3, 4, 5]


@r.published("phasing_counts", values([(b, 2 ** (b - 1), str(2**b), 2 ** (b - 1)) for b in _SNPS], "bubbles, decompositions, labelled, unlabelled"))
def phasing_counts(spark, d):
    """Two haplotypes that differ at b far sites: 2^(b-1) phasings, twice as many with labels."""
    base = gen.random_sequence(600, 12)

    def run(b):
        found = pools.Pool(gen.snp_haplotypes(base, [40 + 100 * i for i in range(b)], 1) + [gen.snp_haplotypes(base, [40 + 100 * i for i in range(b)], 256)[-1]], 12).phasings()
        return found["decompositions"], str(found["labelled"]), found["unlabelled"]

    return literals(spark, [(b,) for b in _SNPS], "bubbles long", run, "decompositions long, labelled string, unlabelled long")


@r.published("recombination_groups", values([("sphere", "0"), ("torus", "Z^2"), ("projective plane", "Z/2")], "surface, recombination"))
def recombination_groups(spark, d):
    surfaces = {"sphere": gen.OCTAHEDRON, "torus": gen.TORUS, "projective plane": gen.PROJECTIVE_PLANE}
    return literals(spark, [(n,) for n in surfaces], "surface string", lambda n: (exact.group_name(*pools.recombination_group(pools.surface_pool(surfaces[n]))),), "recombination string")


@r.published("surface_homology", values([("sphere", 0, "0", 1), ("torus", 2, "Z^2", 1), ("projective plane", 0, "Z/2", 0)], "surface, b1, h1, b2"))
def surface_homology(spark, d):
    """First homology and Betti numbers of triangulated surfaces from their boundary matrices."""
    surfaces = {"sphere": gen.OCTAHEDRON, "torus": gen.TORUS, "projective plane": gen.PROJECTIVE_PLANE}

    def run(name):
        _, (torsion, rank), (_, top) = complexes.Complex(surfaces[name]).homology()
        return rank, exact.group_name(torsion, rank), top

    return literals(spark, [(n,) for n in surfaces], "surface string", run, "b1 long, h1 string, b2 long")


@r.query("squared_laplacians", f"""
WITH l AS MATERIALIZED (SELECT graph_id, i, j, sum(x) AS value FROM (SELECT graph_id, u AS i, v AS j, -m AS x FROM ({r.ARCS}) WHERE u <> v UNION ALL SELECT graph_id, u, u, m FROM ({r.ARCS}) WHERE u <> v) GROUP BY 1, 2, 3)
SELECT a.graph_id AS matrix_id, a.i, b.j, CAST(sum(a.value * b.value) AS BIGINT) AS value FROM l a JOIN l b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY 1, 2, 3 HAVING sum(a.value * b.value) <> 0""")
def squared_laplacians(spark, d):
    """Square of each walk's Laplacian by a sparse matrix product."""
    lap = graphs.laplacian(r.walks(spark, d)).withColumnRenamed("graph_id", "matrix_id")
    return complexes.product(lap, lap)


_BUBBLES = [[2, 2], [2, 2, 2], [3, 2], [2, 3, 2]]


@r.published("splicing_paths", values([("2-2", 4, 3), ("2-2-2", 8, 4), ("3-2", 6, 4), ("2-3-2", 12, 5)], "gene, paths, rank"))
def splicing_paths(spark, d):
    """Source-sink paths of bubble chains and the rank of their path-arc matrix (1 + sum of branches less one)."""

    def run(gene):
        arcs = gen.splice_series([int(x) for x in gene.split("-")])
        paths = counting.dag_paths(arcs, 0, max(v for _, v in arcs))
        return len(paths), exact.rank_mod([[int(i in p) for i in range(len(arcs))] for p in paths])

    return literals(spark, [("-".join(map(str, b)),) for b in _BUBBLES], "gene string", run, "paths long, rank long")


@r.published("path_decompositions", """
WITH f(total, x, y) AS (VALUES (3, 1, 2), (4, 2, 2), (5, 3, 1), (6, 2, 3)),
w AS (SELECT total, x, y, a, x - a AS b, y - a AS c, total - x - y + a AS d FROM f, range(0, 7) t(a) WHERE a <= x AND a <= y AND total - x - y + a >= 0)
SELECT CAST(total AS BIGINT) AS total, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS decompositions,
       CAST(CAST(sum(factorial(CAST(total - 1 AS INTEGER)) / (factorial(CAST(a AS INTEGER)) * factorial(CAST(b AS INTEGER)) * factorial(CAST(c AS INTEGER)) * factorial(CAST(d AS INTEGER)))) * 1000 AS BIGINT) AS VARCHAR) AS sequences_x1000
FROM w GROUP BY 1, 2, 3""")
def path_decompositions(spark, d):
    """Integer path weights of a two-bubble flow with x and y on the first branches, and its weighted closed walks."""

    def run(total, x, y):
        arcs = gen.splice_series([2, 2])
        flow = [x, x, total - x, total - x, y, y, total - y, total - y]
        paths = counting.dag_paths(arcs, 0, 6)
        return len(counting.path_decompositions(arcs, paths, flow)), str(round(counting.augmented_sequences(arcs, 0, 6, flow) * 1000))

    return literals(spark, [(3, 1, 2), (4, 2, 2), (5, 3, 1), (6, 2, 3)], "total long, x long, y long", run, "decompositions long, sequences_x1000 string")


@r.published("three_counts")
def three_counts(spark, d):
    """Box points and reconstructions of planted genomes by enumeration, frontier elimination and fermions, and by rows of prefixes."""

    def run(word):
        c = counting.Cover(gen.planted_repeats(word, 14, 9, 8, 3), 8)
        return c.box_count(), len(c.points()), counting.connected_count(c), str(c.ds_count()), str(counting.tree_frontier(c)), str(counting.fermion_sweep(c))

    return literals(spark, [("ABAB",), ("ABACBC",), ("AABB",)], "word string", run, "box long, points long, connected long, ds string, frontier string, fermion string")


# ---------------------------------------------------------------- encoders and streams


@r.query("local_alignments", """
WITH RECURSIVE p AS (SELECT * FROM (SELECT p_partkey, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL),
h AS (SELECT p_partkey, a, b, 0 AS i, [0 FOR j IN range(length(b) + 1)] AS row, 0 AS best FROM p
  UNION ALL SELECT p_partkey, a, b, i + 1, next, greatest(best, list_max(next)) FROM (
    SELECT *, [list_max([x[t + 1] - 2 * (j - t) FOR t IN range(j + 1)]) FOR j IN range(length(b) + 1)] AS next FROM (
      SELECT *, [CASE WHEN j = 0 THEN 0 ELSE greatest(0, row[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 2 ELSE -1 END, row[j + 1] - 2) END FOR j IN range(length(b) + 1)] AS x FROM h WHERE i < length(a))))
SELECT p_partkey, CAST(best AS BIGINT) AS score FROM h WHERE i = length(a)""")
def local_alignments(spark, d):
    """Smith-Waterman score of each part name with the name of the part before it."""
    parts = r.table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    pairs = graphs.ahead(parts, "p_brand", "p_partkey", F.struct("p_partkey", "p_name"), F.expr("p_partkey div 10000"))
    pairs = pairs.where("ahead is not null").select("ahead.p_partkey", F.col("ahead.p_name").alias("a"), F.col("p_name").alias("b"))

    def run(batches):
        for pdf in batches:
            pdf["score"] = [pools.local_alignment(a, b) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf[["p_partkey", "score"]]

    return pairs.mapInPandas(run, "p_partkey long, score long")


_SCALE = {"r": 3, "e": 1, "i": 4, "n": 2, "g": 5, "l": 1}
_MEAN = "16.0 / 6"
_SPREAD = "sqrt(56.0 / 6 - (16.0 / 6) * (16.0 / 6))"


@r.query("pseudo_composition", f"""
WITH s(c, x) AS (VALUES {', '.join(f"('{c}', {x})" for c, x in _SCALE.items())}), h AS (SELECT c, (x - {_MEAN}) / {_SPREAD} AS v FROM s),
l AS (SELECT p_partkey, length(p_name) AS n, i, substr(p_name, i, 1) AS a, substr(p_name, i + 1, 1) AS b FROM (SELECT *, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
t AS (SELECT p_partkey, n, sum(CASE WHEN a IN ('r', 'e', 'i', 'n', 'g', 'l') THEN 1 ELSE 0 END) AS k, sum(CASE WHEN a = 'r' THEN 1 ELSE 0 END) AS r, sum(coalesce(p.v, 0) * coalesce(q.v, 0)) / (n - 1) AS theta
      FROM l LEFT JOIN h p ON p.c = a LEFT JOIN h q ON q.c = b GROUP BY 1, 2)
SELECT p_partkey, round(r / (k + 0.5 * theta), 6) AS share_r, round(0.5 * theta / (k + 0.5 * theta), 6) AS correlation FROM t""")
def pseudo_composition(spark, d):
    """Amphiphilic pseudo composition of part names over six letters with one scale and one lag."""
    scale = pools.standard_scale(_SCALE)
    part = r.table(spark, d, "part").select("p_partkey", "p_name")

    def run(batches):
        for pdf in batches:
            found = [pools.apaac(s, 1, [scale], letters="reingl") for s in pdf["p_name"]]
            pdf["share_r"], pdf["correlation"] = [round(float(f[0]), 6) for f in found], [round(float(f[-1]), 6) for f in found]
            yield pdf[["p_partkey", "share_r", "correlation"]]

    return part.mapInPandas(run, "p_partkey long, share_r double, correlation double")


@r.query("streamed_symbols", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_symbols(spark, d):
    """Event types of each day by a streaming aggregation with a watermark, run until its source is read."""
    schema = r.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = spectra.windowed_walk_arcs(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type", "1 day", "1 hour")
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    latest = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(latest).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{place}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@r.query("canonical_sequences", "SELECT seq_id, min(rot) AS canonical FROM (SELECT p_partkey AS seq_id, unnest([substr(p_brand, i) || substr(p_brand, 1, i - 1) for i in range(1, length(p_brand) + 1)]) AS rot FROM part) GROUP BY 1")
def canonical_sequences(spark, d):
    """Least rotations again through the SQL function of that name."""
    fs.register(spark)
    r.table(spark, d, "part").createOrReplaceTempView("sw_part")
    return spark.sql("SELECT p_partkey AS seq_id, sw_least_rotation(p_brand) AS canonical FROM sw_part")
