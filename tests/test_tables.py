"""Relational operators against plain versions, readers against small files, streams against batches."""

import gzip
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import sequences as fs
from strandweave.operators import counting as ct
from strandweave.operators import graphs, moves, pools, words
from strandweave.sources import generators as gen
from strandweave.sources import sequences as src
from strandweave.streaming import spectra


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "AC"), (92, "ÄÖACÄÖACÄÖ"), (93, gen.planted_repeats("ABACBC", 9, 5, 6, 2))]
    return spark.createDataFrame(rows, "seq_id long, seq string").repartition(3), dict(rows)


@pytest.mark.parametrize("k,circular", [(3, True), (4, False)])
def test_occurrences(seqs, k, circular):
    df, rows = seqs
    want = Counter()
    for i, s in rows.items():
        s = s or ""
        if len(s) >= k:
            t = s + s[: k - 1] if circular else s
            want.update((i, p, t[p : p + k]) for p in range(len(t) - k + 1))
    assert Counter(tuple(r) for r in words.occurrences(df, k, circular).collect()) == want
    per = Counter((i, w) for i, _, w in want)
    repeated = {(i, p, w) for i, p, w in want if per[(i, w)] > 1}
    assert {tuple(r) for r in words.occurrences(df, k, circular, repeated=True).collect()} == repeated
    total = Counter(w for _, _, w in want)
    assert {r["kmer"]: r["n"] for r in words.word_counts(df, k, circular).collect()} == total
    docs = Counter(w for _, w in per)
    assert {r["kmer"]: r["n"] for r in words.word_counts(df, k, circular, documents=True).collect()} == docs


def test_cover_equals_the_kernel(seqs):
    df, rows = seqs
    got = {}
    for r in words.double_cover(df.where("seq_id <> 92"), 4).collect():
        got.setdefault(r["seq_id"], {})[r["content"]] = (r["tail"], r["head"], r["m"], r["partner"])
    for i, s in rows.items():
        if i == 92 or len(s or "") < 4:
            assert i not in got
            continue
        c = ct.Cover(s, 4)
        assert got.get(i, {}) == {a: (*c.ends[a], m, ct.rc(a)) for a, m in c.m.items()}


def test_compacted_arcs_equal_the_kernel(seqs):
    df, rows = seqs
    got = {}
    for r in words.compacted_arcs(df, 3).collect():
        got.setdefault(r["seq_id"], Counter())[(r["tail"], r["head"])] += 1
    for i, s in rows.items():
        assert got.get(i, Counter()) == (ct.compacted_graph(s, 3) if len(s or "") >= 3 else Counter())


def graph_rows(spark, graphs_):
    return gen.arc_table(spark, graphs_)


def test_components_and_connectivity(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5), (2000, 2000)] + [(3000, 3001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    two = graph_rows(spark, {"a": Counter({(1, 2): 1, (2, 1): 1}), "b": Counter({(1, 2): 1, (3, 4): 2})})
    assert {r["graph_id"]: r["components"] for r in graphs.connected(two).collect()} == {"a": 1, "b": 2}
    assert graphs.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signed_balance(spark):
    rows = [("good", "a", "b", 1), ("good", "b", "c", -1), ("good", "a", "c", -1), ("bad", "a", "b", 1), ("bad", "b", "c", -1), ("bad", "a", "c", 1)]
    got = {r["graph_id"]: r["balanced"] for r in graphs.signed_balance(spark.createDataFrame(rows, "graph_id string, u string, v string, sign int")).collect()}
    assert got == {"good": True, "bad": False}


def test_unitigs_keep_the_group_and_drop_inner_vertices(spark):
    named = {s: ct.circular_graph(s, k) for s, k in (("ACACCAAAACCA", 2), ("AABABBAABABB", 2), ("ACGTTGCAAT", 3))}
    got = {}
    for r in graphs.unitigs(graph_rows(spark, named)).collect():
        got.setdefault(r["graph_id"], Counter())[(r["u"], r["v"])] += r["m"]
    for s, g in named.items():
        c = got.get(s, Counter())
        assert all(d > 1 for d in ct.out_degrees(c).values())
        assert ct.critical_group(c) == ct.critical_group(g)


def test_bundle_contraction(spark):
    base = gen.random_eulerian(5, 2, 3)
    v = ct.vertices(base)[0]
    planted = gen.planted_chain(base, v, ct.out_degrees(base)[v], 3)
    skeleton, chains = graphs.bundle_contract(graph_rows(spark, {"g": planted}))
    arcs = Counter()
    for r in skeleton.collect():
        arcs[(r["u"], r["v"])] += r["m"]
    parts = [(r["r"], r["s"]) for r in chains.collect()]
    rest, more = ct.split_chains(arcs)
    assert ct.chain_prediction(parts + more, rest) == ct.critical_group(planted)


def test_invariants_and_determinants(spark):
    g = ct.circular_graph("ACACCAAAACCA", 2)
    row = ct.graph_invariants(graph_rows(spark, {"g": g})).first()
    assert (row["trees"], row["circuits"], row["group"]) == ("12", "288", "(Z/2)^2 + Z/3")
    cells = spark.createDataFrame([("m", 0, 0, 4), ("m", 0, 1, 2), ("m", 1, 1, 6), ("w", 0, 2, 3)], "matrix_id string, i int, j int, value long")
    got = {r["matrix_id"]: (r["determinant"], r["rank"], r["cokernel"]) for r in ct.determinants(cells).collect()}
    assert got == {"m": ("24", 2, "Z/2 + Z/3 + Z/4"), "w": (None, 1, "Z^2 + Z/3")}
    lap = {(r["i"], r["j"]): r["value"] for r in graphs.laplacian(graph_rows(spark, {"g": Counter({("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 5})})).collect()}
    assert lap == {("a", "a"): 2, ("a", "b"): -2, ("b", "b"): 2, ("b", "a"): -2}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTN", "BANANA", [3, 1, 2], [2, 1], [1, 1])], "a string, b string, p array<int>, x array<int>, y array<int>")
    r = df.select(fs.reverse_complement("a").alias("rc"), fs.least_rotation("b").alias("lr"), fs.permutation_sign("p").alias("s"), fs.is_quotient("x", "y").alias("q"), fs.is_quotient("y", "x").alias("n"), fs.differing_positions("a", "b").alias("d"), fs.log10_factorial(F.lit(5)).alias("f"), fs.spell(F.array(F.lit("ABX"), F.lit("CDX")), 1).alias("w")).first()
    assert (r["rc"], r["lr"], r["s"], r["q"], r["n"], r["d"], round(r["f"], 6), r["w"]) == ("NACGT", "ABANAN", 1, True, False, 4, 2.079181, "ABCD")
    fs.register(spark)
    assert tuple(spark.sql("SELECT sw_rc('AAC'), sw_least_rotation('CAB'), sw_kmers('ABCD', 3), sw_kmers('A', 3)").first()) == ("GTT", "ABC", ["ABC", "BCD"], [])


def test_intervals(spark):
    rng = random.Random(6)
    a = [(i, lo := rng.randint(-50, 500), lo + rng.randint(-3, 90)) for i in range(80)]
    b = [(i, lo := rng.randint(-50, 500), lo + rng.randint(0, 9)) for i in range(80)]
    got = {(r["a_id"], r["b_id"]) for r in graphs.overlapping(spark.createDataFrame(a, "a_id int, a_lo int, a_hi int"), spark.createDataFrame(b, "b_id int, b_lo int, b_hi int"), 16).collect()}
    assert got == {(i, j) for i, p, q in a for j, r, s in b if p <= q and p <= s and r <= q}


def test_closure_by_rounds_equals_the_kernel(spark):
    rows = [(0, "ACGTTGCAAC"), (1, "GGCATTGCC"), (2, "AAAA")]
    got = {}
    for r in moves.closures(spark.createDataFrame(rows, "seq_id long, seq string"), 2).collect():
        got.setdefault(r["seq_id"], set()).add(r["word"])
    assert got == {i: moves.closure(s, 2) for i, s in rows}
    assert moves.flip_distances("ACGTTGCAAC", 2)[moves.canonical("ACGTTGCAAC")] == 0


def test_mean_pool(spark):
    weights = {0: {(0, "A"): 2, (1, "C"): -1}, 1: {(1, "^"): 3}}
    df = pools.mean_pool(spark.createDataFrame([(1, "ACCA")], "seq_id int, seq string"), spark.createDataFrame([(f, o, c, x) for f, w in weights.items() for (o, c), x in w.items()], "filter int, offset int, letter string, weight long"), spark.createDataFrame([(0, 1), (1, -1)], "filter int, bias long"), 2)
    s = "^ACCA$"
    want = {(f, sum(max(0, b + sum(w.get((o, s[i + o]), 0) for o in (0, 1))) for i in range(5))) for f, (w, b) in {0: (weights[0], 1), 1: (weights[1], -1)}.items()}
    assert {(r["filter"], r["total"]) for r in df.collect()} == want


# ------------------------------------------------------------ sources and sinks


def test_fasta_round_trip(spark, tmp_path):
    rows = [("one", gen.random_sequence(150, 1)), ("two", gen.random_sequence(70, 2)), ("three", "ACGNNT")]
    src.write_fasta(spark.createDataFrame(rows, "name string, seq string"), str(tmp_path / "f"))
    got = {r["name"]: r["seq"] for r in src.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == dict(rows)
    assert {r["seq"] for r in src.read_fasta(spark, str(tmp_path / "f"), "mask").where("name = 'three'").collect()} == {"ACGAAT"}
    with pytest.raises(Exception, match="outside ACGT"):
        src.read_fasta(spark, str(tmp_path / "f"), "raise").collect()
    (tmp_path / "p.txt").write_text(" acgt\n")
    assert src.read_plain(spark, str(tmp_path / "p.txt")).first()["seq"] == "ACGT"


def test_headers_may_hold_the_record_mark(spark, tmp_path):
    (tmp_path / "h.fa").write_bytes(b">a first > second\r\nAC\r\ngt\r\n>b\n\n>c >\nA\n")
    assert [tuple(r)[1:] for r in src.read_fasta(spark, str(tmp_path / "h.fa")).collect()] == [("a", "first > second", "ACGT"), ("b", "", ""), ("c", ">", "A")]


def test_isolates_are_normalised(spark):
    ref = gen.random_sequence(400, 7)
    turned = ref[150:] + ref[:150]
    rows = [(0, "same", ref), (1, "turned", turned), (2, "other strand", ct.rc(turned[:200] + "A" + turned[201:])), (3, "stranger", gen.random_sequence(400, 8)), (4, "short", ref[:100]), (5, "letters", ref[:399] + "N")]
    got = {r["name"]: r["seq"] for r in src.normalised_isolates(spark.createDataFrame(rows, "seq_id long, name string, seq string"), ref, low=390, high=410).collect()}
    assert set(got) == {"same", "other strand"} and all(s[:12] == ref[:12] for s in got.values())


def test_feature_and_protein_tables(spark, tmp_path):
    (tmp_path / "ft.txt").write_text(">Feature x\n<10\t20\tgene\n\t\t\tgene\tabc\n30\t25\tCDS\n\t\t\tprotein_id\tp\n\t\t\tproduct\tthing\n\t\t\tproduct\tother\n40\t>50\trRNA\n")
    got = {tuple(r) for r in src.read_features(spark, str(tmp_path / "ft.txt")).collect()}
    assert got == {(25, 30, "-", "CDS", "thing"), (40, 50, "+", "rRNA", "")}
    with gzip.open(tmp_path / "p.tsv.gz", "wt") as f:
        f.write("Entry\tGene\tFamilies\tLength\tSequence\nP1\tG\tfam a; fam b\t3\tMKV\nP2\t\t\t0\t\n")
    assert [tuple(r) for r in src.read_proteins(spark, str(tmp_path / "p.tsv.gz")).collect()] == [("P1", "G", "fam a", "MKV")]


def test_features_that_cross_shards_and_splits(spark, tmp_path):
    """no task orders a whole file; a feature goes on in later shards and splits, never in another file."""
    rng, want = random.Random(27), set()
    kinds = ("rRNA", "CDS", "mobile_element", "repeat_region", "gene")
    for f in range(3):
        lines = ["\t\t\tproduct\tof no feature"]
        for i in range(150):
            a, b, kind = rng.randrange(10**6), rng.randrange(10**6), rng.choice(kinds)
            lines.append(f"{a}\t{b}\t{kind}")
            notes = [(rng.choice(["note", "note", "note", "gene", "product"]), f"v{f}-{i}-{j}") for j in range(rng.choice([0, 1, 3, 40]))]
            lines += [f"\t\t\t{k}\t{v}" for k, v in notes]
            if kind != "gene":
                want.add((min(a, b), max(a, b), "-" if a > b else "+", kind, next((v for k, v in notes if k != "note"), "")))
        (tmp_path / f"f{f}.txt").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, shard in ((1 << 27, 1 << 16), (1 << 27, 3), (1500, 7), (300, 1)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = [tuple(r) for r in src.read_features(spark, str(tmp_path), shard=shard).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_result_table_resumes(spark, tmp_path):
    t = src.ResultTable(spark, str(tmp_path / "r"), "points long, total string")
    batches = spark.range(4).withColumnRenamed("id", "batch")
    assert t.pending("a", batches).count() == 4
    t.add("a", spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "batch long, points long, total string"))
    assert {r["batch"] for r in t.pending("a", batches).collect()} == {0, 3} and t.pending("b", batches).count() == 4


def test_streamed_spectrum_equals_the_batch(spark, tmp_path):
    rows = [(i, gen.random_sequence(40, i)) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "seq_id long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spectra.running_spectrum(spectra.stream_sequences(spark, str(tmp_path / "in")), 3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("spectrum").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = words.word_counts(spark.createDataFrame(rows, "seq_id long, seq string"), 3)
    assert {tuple(r) for r in spark.table("spectrum").collect()} == {tuple(r) for r in batch.collect()}


def test_branch_words_as_codes_equal_those_as_text(spark):
    rows = [(None if i % 5 == 0 else f"p{i % 2}", gen.random_sequence(n, i)) for i, n in enumerate((300, 200, 40, 7, 6, 5, 3, 90, 0))] + [("p0", None)]
    df = spark.createDataFrame(rows, "pool string, seq string").repartition(3)
    for k in (1, 4):
        plain, coded = (sorted(map(tuple, words.pooled_branch_words(df, k, alphabet=a).collect()), key=str) for a in (None, "ACGT"))
        assert coded and plain == coded
    with pytest.raises(Exception, match="outside ACGT"):
        words.pooled_branch_words(spark.createDataFrame([("p", "ACGNACGT")], "pool string, seq string"), 2, alphabet="ACGT").collect()


def test_paths_of_any_length_and_endless_ones(spark):
    chain = [(str(i), str(i + 1), 2) for i in range(7)]
    got = {r["node"]: r["paths"] for r in graphs.path_counts(spark.createDataFrame(chain, "u string, v string, m long"), "0").collect()}
    assert got == {str(i): 2**i for i in range(8)}
    with pytest.raises(ValueError, match="cycle"):
        graphs.path_counts(spark.createDataFrame([("0", "1", 1), ("1", "0", 1)], "u string, v string, m long"), "0")
    with pytest.raises(RuntimeError, match="still growing"):
        moves.closures(spark.createDataFrame([(0, "AABABBAB")], "seq_id long, seq string"), 2, rounds=0)


def test_walks_in_shards_and_upper_medians(spark):
    rng = random.Random(1)
    rows = [(u, t, rng.choice("abc")) for u in range(5) for t in sorted(rng.sample(range(1000), 1 if u == 4 else 60))]
    df = spark.createDataFrame(rows, "user long, t long, x string").repartition(3)
    want = Counter()
    for u in range(5):
        w = [x for v, _, x in rows if v == u]
        want.update((u, a, b) for a, b in zip(w, w[1:] + w[:1]))
    for shard in (None, F.floor(F.col("t") / 100), F.col("t")):
        got = {(r["graph_id"], r["u"], r["v"]): r["m"] for r in graphs.walk_arcs(df, "user", ["t"], "x", shard).collect()}
        assert got == want
    values = [(k, rng.choice([1, 5, 5, rng.randrange(10**6)])) for k in ("p", "q", None) for _ in range(rng.randrange(1, 400))]
    got = {r["k"]: (r["n"], r["median"]) for r in graphs.upper_median(spark.createDataFrame(values + [("p", None)], "k string, v long"), "k", "v").collect()}
    for k in ("p", "q", None):
        own = sorted(v for a, v in values if a == k)
        assert got[k] == (len(own), own[len(own) // 2])


def test_results_added_again_are_there_once(spark, tmp_path):
    from strandweave.sources.sequences import ResultTable

    table = ResultTable(spark, str(tmp_path / "results"), "name string, n long")
    batches = spark.createDataFrame([(i, f"b{i}", 2 * i) for i in range(6)], "batch long, name string, n long")
    assert table.rows().count() == 0 and table.pending("a/b=c", batches).count() == 6
    table.add("a/b=c", batches.where("batch < 4"))
    table.add("a/b=c", batches.where("batch > 1"))  # a second writer, or a retry
    table.add("other", batches.where("batch = 0"))
    got = sorted(tuple(r) for r in table.rows().where("sig = 'a/b=c'").select("batch", "name", "n").collect())
    assert got == [(i, f"b{i}", 2 * i) for i in range(6)] and table.pending("a/b=c", batches).count() == 0
    assert table.pending("other", batches).count() == 5


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_next_row_in_shards(spark, shard):
    rows = [("a", i * 2, f"v{i}") for i in range(20)] + [("b", 5, "x"), (None, 1, "n1"), (None, 9, None), (None, 12, "n3")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    got = {(r["k"], r["o"]): r["ahead"] for r in graphs.ahead(df, "k", "o", F.struct("o", "v"), F.expr(f"o div {shard}")).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        own = sorted((o, v) for key, o, v in rows if key == k) if k else [(1, "n1"), (9, None), (12, "n3")]
        for (o, _), after in zip(own, [*own[1:], None]):
            assert (tuple(got[k, o]) if got[k, o] else None) == after


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_arcs_and_covers_of_a_sequence_are_made_in_its_row(seqs):
    df, rows = seqs
    df = df.where("seq_id <> 92")
    for made in (words.compacted_arcs, words.double_cover, words.inverted_repeats, words.arc_summary):
        assert shuffles(made(df, 4)) == shuffles(df)
    got = {r["seq_id"]: tuple(r)[1:] for r in words.inverted_repeats(df, 4).collect()}
    for i, s in rows.items():
        if i != 92 and len(s or "") >= 4:
            at = [(s + s[:3])[x : x + 4] for x in range(len(s))]
            hits = {w for w in at if ct.rc(w) in at}
            assert got.get(i) == ((len(hits), sum(w == ct.rc(w) for w in hits), min(map(at.index, hits))) if hits else None)


def test_clusters_of_equal_intervals_follow_the_ties(spark):
    rows = [(1, n, "ab"[n % 2], 5, 9) for n in range(6)]
    for turned in (rows, rows[::-1]):
        df = spark.createDataFrame(turned, "k int, id int, kind string, lo long, hi long").coalesce(1)
        got = graphs.gap_clusters(df, "k", "lo", "hi", 10, "kind", ("id",)).collect()
        assert sorted((r["id"], r["cluster"]) for r in got) == [(n, n) for n in range(6)]


@pytest.mark.parametrize("local", [2, 1 << 20])
def test_components_of_stars(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL", local)
    edges = [(f"v{a}", f"v{a + d}") for a in range(0, 60, 10) for d in (0, 1, 3, 7)] + [("v9", "v10"), ("v59", None)]
    lot = next(graphs._stars_of([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges)], names=["a", "b"])]))
    assert lot.num_rows == len({x for e in edges for x in e})  # one row a vertex
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "u string, v string").repartition(3)).collect()}
    assert got["v17"] == "v10" and got["v9"] == "v10" and got["v3"] == "v0" and got["v59"] == "v59"


def test_scratch_tables_are_merged_where_asked(spark):
    arcs = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1), (1, "c", "a", 1), (1, "a", "c", 1)], "graph_id int, u string, v string, m long")
    for made in (graphs.unitigs, graphs.detachments):
        assert "BroadcastHashJoin" not in made(arcs)._jdf.queryExecution().executedPlan().toString()


def test_mean_pool_shuffles_no_windows(spark):
    weights = spark.createDataFrame([(0, 0, "a", 2), (0, 1, "b", -1)], "filter int, offset int, letter string, weight long")
    seqs = spark.createDataFrame([(1, "aab"), (2, ""), (3, None)], "seq_id long, seq string")
    made = pools.mean_pool(seqs, weights, spark.createDataFrame([(0, 1)], "filter int, bias long"), 2)
    # windows ^a aa ab b$ score 1, 3, 2, 1; of an empty sequence ^$ scores 1
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, 7, 4), (2, 0, 1, 1)]
    assert "seq_id" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x)
