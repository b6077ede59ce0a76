"""Large matrices, nerves and graphs as tables against plain versions."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import complements, exact, frontier, graphs, large_matrices as lm, nerve, paths, pools


def table(spark, rows):
    cells = [(i, j, int(x)) for i, row in enumerate(rows) for j, x in enumerate(row) if x]
    return spark.createDataFrame(cells, "i long, j long, value long").repartition(3)


@pytest.mark.parametrize("p", [2, 7, lm.PRIME])
def test_rank_of_sparse_matrices(spark, monkeypatch, p):
    rng = np.random.default_rng(p)
    for core, lot in ((3, 5), (256, 4096)):
        monkeypatch.setattr(lm, "CORE", core)
        monkeypatch.setattr(lm, "LOT", lot)
        for n, m, share in ((14, 18, 0.12), (20, 9, 0.3)):
            rows = rng.integers(-9, 10, (n, m)) * (rng.random((n, m)) < share)
            rows[n - 1] = rows[0] + 3 * rows[1]
            rows[:, 0] = rows[:, 1]
            assert lm.rank(table(spark, rows), p) == exact.rank_mod(rows.tolist(), p)
    assert lm.rank(table(spark, [[0]]), p) == 0
    assert lm.nullity(table(spark, [[p, 1], [0, 2 * p]]), 5, p) == 4


def test_rank_of_graphs_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(lm, "CORE", 8)
    rng = random.Random(4)
    edges = [(0, v) for v in range(1, 150)] + [(rng.randrange(150, 400), rng.randrange(150, 400)) for _ in range(260)] + [(v, v + 1) for v in range(500, 600)]
    edges = [(a, b) for a, b in edges if a != b] + [(0, 1)] * 3
    cells = [(e, a, 1) for e, (a, b) in enumerate(edges)] + [(e, b, -1) for e, (a, b) in enumerate(edges)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    want = len(parent) - sum(parent[x] == x for x in parent)
    assert lm.rank(spark.createDataFrame(cells, "i long, j long, value long")) == want
    units, left = lm.unit_pivots(spark.createDataFrame(cells, "i long, j long, value long"))
    assert units == want and left.count() == 0


def test_unit_pivots_keep_the_cokernel(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        rows = rng.integers(-3, 4, (7, 8)) * (rng.random((7, 8)) < 0.4)
        units, left = lm.unit_pivots(table(spark, rows))
        cells = left.collect()
        at = {i: n for n, i in enumerate(sorted({r["i"] for r in cells}))}, {j: n for n, j in enumerate(sorted({r["j"] for r in cells}))}
        rest = [[0] * len(at[1]) for _ in at[0]]
        for r in cells:
            rest[at[0][r["i"]]][at[1][r["j"]]] = r["value"]
        nonzero = lambda a: sorted(abs(d) for d in exact.smith_diagonal(a) if d) if a else []
        assert nonzero(rows.tolist()) == sorted([1] * units + nonzero(rest))
    assert lm.unit_pivots(table(spark, [[1, 0], [1, 2]]))[0] == 1 and lm.unit_pivots(table(spark, [[2, 3]]))[0] == 0
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|overflow"):
        lm.unit_pivots(table(spark, [[1, 2**40], [2**40, 5]]))


# ------------------------------------------------------------ nerves

PROJECTIVE_PLANE = [(1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 2, 6), (2, 3, 5), (3, 4, 6), (2, 4, 5), (3, 5, 6), (2, 4, 6)]
SPHERE = list(combinations(range(4), 3))
TORUS = [((i, j), ((i + 1) % 3, j), ((i + 1) % 3, (j + 1) % 3)) for i in range(3) for j in range(3)] + [((i, j), (i, (j + 1) % 3), ((i + 1) % 3, (j + 1) % 3)) for i in range(3) for j in range(3)]
TORUS = [tuple(3 * a + b for a, b in t) for t in TORUS]


def pool_tables(spark, strains):
    nodes, arcs = {}, {}
    for n, strain in enumerate(strains):
        for u, v, name in strain:
            for x in (u, v):
                nodes.setdefault(str(x), set()).add(n)
            arcs.setdefault((str(u), str(v), name), set()).add(n)
    vertices = spark.createDataFrame([(v, sorted(s)) for v, s in nodes.items()], "v string, strains array<int>")
    return vertices, spark.createDataFrame([(u, v, sorted(s)) for (u, v, _), s in arcs.items()], "u string, v string, strains array<int>")


@pytest.mark.parametrize("triangles,rank,free,mod2", [(SPHERE, 0, True, 0), (TORUS, 2, True, 2), (PROJECTIVE_PLANE, 0, False, 1)])
def test_nerves_of_three_surfaces(spark, triangles, rank, free, mod2):
    strains = pools.surface_pool(triangles)
    got = nerve.homology(*pool_tables(spark, strains), primes=(2, 3))
    assert (got["rank"], got["free"], got["primes"]) == (rank, free, {2: mod2, 3: rank})
    assert pools.nerve_homology(strains) == ([2] if not free else [], rank)


def test_nerve_of_random_pools(spark):
    rng = random.Random(9)
    for _ in range(2):
        arcs = [(rng.randrange(12), rng.randrange(12), f"a{i}") for i in range(30)]
        strains = [[a for a in arcs if rng.random() < 0.55] for _ in range(4)]
        torsion, rank = pools.nerve_homology(strains)
        got = nerve.homology(*pool_tables(spark, strains))
        assert got["rank"] == rank and (got["free"] or torsion)


# ------------------------------------------------------------ paths and strong components


def plain_unitigs(arcs, cycles):
    """By walking: (graph, u, v, m, arcs, label)."""
    out = []
    for g in {a[0] for a in arcs}:
        mine = [a[1:] for a in arcs if a[0] == g]
        outs, ins = {}, {}
        for u, v, m, _ in mine:
            outs[u], ins[v] = outs.get(u, 0) + m, ins.get(v, 0) + m
        inner = {x for x in outs if outs[x] == 1 and ins.get(x) == 1}
        after = {u: (v, label) for u, v, _, label in mine if u in inner}

        def walk(v, label):
            n = 1
            while v in inner:  # noqa: B023
                v, more = after[v]  # noqa: B023
                label, n = label + more, n + 1
            return v, n, label

        seen = set()
        for u, v, m, label in mine:
            if u not in inner:
                end, n, text = walk(v, label)
                out.append((g, u, end, m, n, text))
                while v in inner:
                    seen.add(v)
                    v = after[v][0]
        if cycles:
            for x in sorted(inner - seen):
                if x in inner - seen:
                    inner.discard(x)
                    end, n, text = walk(*after[x])
                    out.append((g, x, end, 1, n, text))
                    v = after[x][0]
                    while v != x:
                        seen.add(v)
                        v = after[v][0]
    return sorted(out)


def graph_rows():
    rng = random.Random(12)
    arcs = [(1, i, i + 1, 1, "acgt"[i % 4]) for i in range(60)] + [(1, 60, 0, 1, "x"), (1, 60, 61, 2, "y"), (1, 61, 62, 1, "z"), (1, 63, 64, 1, "q")]
    arcs += [(2, i, (i + 1) % 37, 1, chr(97 + i % 26)) for i in range(37)] + [(2, 50, 50, 1, "loop")] + [(2, 100 + (i * 5) % 16, 100 + ((i + 1) * 5) % 16, 1, chr(65 + i)) for i in range(16)]
    arcs += [(3, rng.randrange(30), rng.randrange(30), 1, str(i)) for i in range(34)]
    return [a for n, a in enumerate(arcs) if a[:3] not in {b[:3] for b in arcs[:n]}]


@pytest.mark.parametrize("cycles", [False, True])
def test_labelled_unitigs(spark, cycles):
    rows = graph_rows()
    df = spark.createDataFrame(rows, "graph_id int, u long, v long, m long, label string").repartition(3)
    got = sorted(tuple(r) for r in paths.labelled_unitigs(df, cycles).collect())
    assert got == plain_unitigs(rows, cycles)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n = 30_000
    ids = spark.range(n).select(F.lit(0).alias("graph_id"), F.expr("(id * 7919) % 104729").alias("u"), F.expr("((id + 1) * 7919) % 104729").alias("v"), F.lit(1).cast("long").alias("m"), F.expr("char(97 + id % 26)").alias("label"))
    saved = []
    plain = paths.Scratch.save
    monkeypatch.setattr(paths.Scratch, "save", lambda self, df, name: (saved.append(name), plain(self, df, name))[1])
    r = paths.labelled_unitigs(ids).collect()
    assert len(r) == 1 and r[0]["arcs"] == n and r[0]["label"] == "".join(chr(97 + i % 26) for i in range(n))
    assert sum(s.startswith("rank") for s in saved) <= 18


def plain_strong(arcs):
    out = set()
    for g in {a[0] for a in arcs}:
        after = {}
        for a, u, v, *_ in arcs:
            if a == g:
                after.setdefault(u, set()).add(v)
                after.setdefault(v, set())
        reach = {}
        for x in after:
            seen, line = {x}, [x]
            while line:
                for y in after[line.pop()] - seen:
                    seen.add(y)
                    line.append(y)
            reach[x] = seen
        out |= {(g, x, min(y for y in reach[x] if x in reach[y])) for x in after}
    return out


@pytest.mark.parametrize("trims", [0, 3])
def test_strong_components(spark, trims):
    rows = [a for a in graph_rows() if a[1] < 12 or a[0] > 1]
    df = spark.createDataFrame([a[:3] for a in rows], "graph_id int, u long, v long").repartition(3)
    assert {tuple(r) for r in paths.strong_components(df, trims).collect()} == plain_strong(rows)
    assert paths.strong_components(df.where("false")).count() == 0


# ------------------------------------------------------------ frontier


def plain_choices(arcs):
    count = 0
    for choice in product(*(range(m + 1) for _, _, m in arcs)):
        over = {}
        for c, (u, v, _) in zip(choice, arcs):
            over[u] = over.get(u, 0) - c
            over[v] = over.get(v, 0) + c
        count += not any(over.values())
    return count


def test_balanced_choices(spark):
    rng = random.Random(8)
    graphs = {g: [(rng.randrange(4), rng.randrange(4), rng.randint(1, 3)) for _ in range(rng.randint(1, 7))] for g in range(12)}
    graphs = {g: [(u, v, m) for n, (u, v, m) in enumerate(a) if (u, v) not in {b[:2] for b in a[:n]}] for g, a in graphs.items()}
    df = spark.createDataFrame([(g, *a) for g, arcs in graphs.items() for a in arcs], "graph_id int, u int, v int, m long").repartition(3)
    got = {r["graph_id"]: (int(r["choices"]), r["peak"]) for r in frontier.balanced_choices(df).collect()}
    assert {g: n for g, (n, _) in got.items()} == {g: plain_choices(a) for g, a in graphs.items()}
    assert all(p >= 1 for _, p in got.values())
    assert frontier.balanced_choices(df.where("false")).count() == 0


# ------------------------------------------------------------ complements


@pytest.mark.parametrize("members", [2, 3])
def test_complements(spark, members):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(3), rng.randrange(4)]) for i in range(40)] + [(90, None), (91, [1]), (92, [-1, 2]), (93, [9, 9]), (94, [None, 1])]
    target = [2, 4] if members == 2 else [3, 5]
    want = {}
    for combo in combinations([r for r in rows if r[1] and len(r[1]) == 2 and None not in r[1] and min(r[1]) >= 0], members):
        if [sum(x) for x in zip(*(v for _, v in combo))] == target:
            key = tuple(sorted(tuple(v) for _, v in combo))
            want[key] = want.get(key, 0) + 1
    least = {}
    for i, v in rows:
        if v:
            least.setdefault(tuple(v), i)
    df = spark.createDataFrame(rows, "id long, p array<long>").repartition(3)
    got = complements.complement_classes(df, target, members).collect()
    assert {tuple(tuple(v) for v in r["vectors"]): r["ways"] for r in got} == want and len(got) == len(want)
    assert all(r["firsts"] == [least[tuple(v)] for v in r["vectors"]] for r in got)
    with pytest.raises(ValueError):
        complements.complement_classes(df, [10**4, 10**4], 2)


# ------------------------------------------------------------ detachments


def test_detachments_keep_balance(spark):
    rng = random.Random(14)
    arcs = {}
    for g in range(6):
        walk = [rng.choice("ABCDE") for _ in range(14)]
        for u, v in zip(walk, walk[1:] + walk[:1]):
            arcs[g, u, v] = arcs.get((g, u, v), 0) + 1
    df = spark.createDataFrame([(*k, m) for k, m in arcs.items()], "graph_id int, u string, v string, m long").repartition(3)
    got = {}
    for r in graphs.detachments(df).collect():
        got.setdefault((r["graph_id"], r["vertex"]), {}).setdefault((r["head"], r["tail"]), {})[r["u"], r["v"]] = r["m"]
    candidates = {(g, x) for g in range(6) for x in "ABCDE" if sum(m for (h, u, _), m in arcs.items() if h == g and u == x) == 3 and (g, x, x) not in arcs}
    assert set(got) == candidates and candidates
    for (_, x), splits in got.items():
        assert set(splits) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)}
        for changed in splits.values():
            for end in (x, x + "'"):
                assert sum(m for (u, _), m in changed.items() if u == end) == sum(m for (_, v), m in changed.items() if v == end) == 2
            assert sum(changed.values()) == 7
    (g, x), splits = sorted(got.items())[0]
    into = sorted(u for (h, u, v), m in arcs.items() for _ in range(m) if h == g and v == x)
    assert all(changed[into[a - 1], x + "'"] == 1 for (a, _), changed in splits.items())


def test_a_graph_is_contracted_without_rounds(spark, monkeypatch):
    edges = [(a, b) for a in range(20) for b in range(20, 330) if (a * b) % 7 == 1]
    cells = spark.createDataFrame([(e, x, s) for e, ab in enumerate(edges) for x, s in zip(ab, (1, -1))], "i long, j long, value long")
    monkeypatch.setattr(lm, "_round", None)  # no round is needed
    monkeypatch.setattr(lm, "CORE", 8)
    units, left = lm.unit_pivots(cells)
    found = {r["component"] for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = len({x for e in edges for x in e}) - len(found)
    assert units == want == lm.rank(cells) and not left.count()


def test_arcs_are_ordered_without_broadcasts(spark):
    arcs = spark.createDataFrame([(1, "a", "b", 2), (1, "b", "a", 2), (2, "a", "c", 1)], "graph_id int, u string, v string, m long")
    assert "BroadcastHashJoin" not in frontier.arc_order(arcs)._jdf.queryExecution().executedPlan().toString()


def test_cells_by_numbers_are_the_cells_by_structs(spark):
    """sets and whole numbers travel as one number; what does not fit, and text, travels as structs."""
    rng = random.Random(19)
    arcs = {(rng.randrange(-9, 9), rng.randrange(-9, 9)): rng.sample("abcde", rng.randrange(6)) for _ in range(40)}
    nodes = {v: rng.sample("abcde", rng.randrange(6)) for v in range(-9, 12)}
    want = set()
    for n in (1, 2, 3):
        for sigma in combinations("abcde", n):
            least = {v: v for v in nodes if set(sigma) <= set(nodes[v])}
            edges = [e for e, s in arcs.items() if set(sigma) <= set(s)]
            least |= {v: v for e in edges for v in e}
            for _ in least:
                for u, v in edges:
                    least[u] = least[v] = min(least[u], least[v])
            want |= {(sigma, v, c) for v, c in least.items()}
    tables = lambda t, f: (spark.createDataFrame([(f(v), s) for v, s in nodes.items()], f"v {t}, strains array<string>"), spark.createDataFrame([(f(u), f(v), s) for (u, v), s in arcs.items()], f"u {t}, v {t}, strains array<string>"))
    for kind, there, back in (("int", int, int), ("long", lambda x: x * 10**6, lambda x: x // 10**6), ("long", lambda x: x * 5 * 10**17, lambda x: x // (5 * 10**17)), ("string", lambda x: chr(100 + x), lambda x: ord(x) - 100)):
        found = nerve.cells(*tables(kind, there))
        assert {(tuple(r["sigma"]), back(r["v"]), back(r["cell"])) for r in found.collect()} == want
        assert (found.schema["v"].dataType.simpleString(), found.count()) == (kind.replace("long", "bigint"), len(want))


def test_strains_are_gathered_as_bits_or_collected(spark):
    for n in (3, 63, 64, 70):
        rows = [(k, f"f{k * i % n}") for k in (1, 2, 5) for i in range(n)] + [(7, None), (1, None)]
        got = {r["k"]: sorted(r["strains"]) for r in nerve.gathered(spark.createDataFrame(rows, "k int, f string"), "f", "k").collect()}
        assert got == {k: sorted({f for x, f in rows if x == k and f}) for k in (1, 2, 5, 7)}
