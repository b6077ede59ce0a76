"""Seeded and closed-form inputs: genomes with planted repeats, Eulerian digraphs, surfaces, snarl chains, splicing DAGs."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def random_sequence(n: int, seed: int, letters: str = "ACGT") -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def planted_repeats(word: str, length: int, spacer: int, k: int, seed: int) -> str:
    """A circular genome in which the letters of ``word`` stand for repeats of ``length`` letters, with distinct spacers.

    Drawn again until no other word of k letters repeats.
    """
    rng = random.Random(seed)
    while True:
        repeats = {c: "".join(rng.choice("ACGT") for _ in range(length)) for c in sorted(set(word))}
        s = "".join(repeats[c] + "".join(rng.choice("ACGT") for _ in range(spacer)) for c in word)
        t = s + s[: k - 1]
        many = Counter(t[i : i + k] for i in range(len(s)))
        inside = {r[i : i + k] for r in repeats.values() for i in range(length - k + 1)}
        if all(n == 1 or w in inside for w, n in many.items()) and all(many[r[i : i + k]] == word.count(c) for c, r in repeats.items() for i in range(length - k + 1)):
            return s


def random_eulerian(n: int, cycles: int, seed: int) -> Counter:
    """A connected balanced multigraph on n vertices: a Hamiltonian cycle and further random cycles."""
    rng = random.Random(seed)
    arcs: Counter = Counter()
    for i in range(cycles + 1):
        names = rng.sample(range(n), n if i == 0 else rng.randint(1, n))
        for u, v in zip(names, names[1:] + names[:1]):
            arcs[(u, v)] += 1
    return arcs


def random_regular(n: int, seed: int, degree: int = 4) -> list[tuple[int, int]]:
    """A connected undirected multigraph with all degrees equal, from a random pairing of half-edges."""
    rng = random.Random(seed)
    while True:
        halves = [v for v in range(n) for _ in range(degree)]
        rng.shuffle(halves)
        edges = list(zip(halves[::2], halves[1::2]))
        reach = {0}
        for _ in range(n):
            reach |= {x for e in edges if reach & set(e) for x in e}
        if len(reach) == n:
            return edges


def planted_chain(arcs: Counter, vertex, r: int, s: int) -> Counter:
    """Split a vertex of degree r into a bundle chain of s vertices (s-1 bundles of r parallel arcs); names become text."""
    names = [f"{vertex}.{i}" for i in range(s)]
    out = Counter({(names[-1] if u == vertex else str(u), names[0] if v == vertex else str(v)): m for (u, v), m in arcs.items()})
    for a, b in zip(names, names[1:]):
        out[(a, b)] += r
    return out


def snarl_chain(snarls: int, inside: int, seed: int) -> Counter:
    """A circular chain of snarls: hubs joined by small random balanced subgraphs."""
    rng = random.Random(seed)
    arcs: Counter = Counter()
    for i in range(snarls):
        hub, after = ("h", i), ("h", (i + 1) % snarls)
        for _ in range(2):
            walk = [hub, *((i, rng.randrange(inside)) for _ in range(inside)), after]
            for u, v in zip(walk, walk[1:]):
                arcs[(u, v)] += 1
    return arcs


def undirected_circuit(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices of a closed walk that uses every edge of a connected even multigraph once (first = last)."""
    left: dict[int, list[int]] = {}
    for i, e in enumerate(edges):
        for v in e:
            left.setdefault(v, []).append(i)
    used, stack, walk = set(), [edges[0][0]], []
    while stack:
        v = stack[-1]
        while left[v] and left[v][-1] in used:
            left[v].pop()
        if left[v]:
            i = left[v].pop()
            used.add(i)
            a, b = edges[i]
            stack.append(b if a == v else a)
        else:
            walk.append(stack.pop())
    return walk


def realised_graph(edges: list[tuple[int, int]], k: int, spacer: int, seed: int, tries: int = 200) -> str:
    """A circular sequence whose double cover is a given even multigraph of degree at most four.

    Every vertex becomes a palindromic word of k letters (k even) and every
    edge a spacer between two of them, in the order of a closed walk.  A vertex
    is passed at most twice; the letters next to its word are chosen so that on
    both strands no two passages agree beyond the word.
    """
    from strandweave.operators.counting import Cover, rc

    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    walk = undirected_circuit(edges)[:-1]
    for _ in range(tries):
        words = {v: (h := draw(k // 2)) + rc(h) for v in sorted(set(walk))}
        passed: Counter = Counter()
        around = []
        for v in walk:
            around.append(("CA"[passed[v]], "AC"[passed[v]]))
            passed[v] += 1
        s = "".join(words[v] + around[i][1] + draw(spacer - 2) + around[(i + 1) % len(walk)][0] for i, v in enumerate(walk))
        cover = Cover(s, k)
        if len(set(words.values())) == len(words) and cover.vertices == sorted(words.values()) and len(cover.m) == 2 * len(edges):
            return s
    raise ValueError("no sequence found; use longer words")


def snp_haplotypes(base: str, sites: list[int], copies: int) -> list[str]:
    """``copies`` haplotypes of a sequence: site j is changed in the copies whose number has bit j mod 8 set."""
    turn = str.maketrans("ACGT", "CGTA")
    return ["".join(c.translate(turn) if i in sites and copy >> (sites.index(i) % 8) & 1 else c for i, c in enumerate(base)) for copy in range(copies)]


def splice_series(bubbles: list[int]) -> list[tuple[int, int]]:
    """A splicing DAG: consecutive bubbles with the given numbers of parallel exons."""
    arcs, at = [], 0
    for n in bubbles:
        for j in range(n):
            arcs += [(at, at + 1 + j), (at + 1 + j, at + n + 1)]
        at += n + 1
    return arcs


#: Vertex-minimal triangulations of the sphere (octahedron), torus and projective plane.
OCTAHEDRON = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 1, 4), (1, 2, 5), (2, 3, 5), (3, 4, 5), (1, 4, 5)]
TORUS = [tuple(sorted((i + d) % 7 for d in t)) for i in range(7) for t in ((0, 1, 3), (0, 2, 3))]
PROJECTIVE_PLANE = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 1, 5), (1, 2, 4), (2, 3, 5), (1, 3, 4), (2, 4, 5), (1, 3, 5)]


def arc_table(spark: SparkSession, graphs: dict[str, Counter]) -> DataFrame:
    """(graph_id, u, v, m) of named multigraphs."""
    rows = [(g, str(u), str(v), int(m)) for g, arcs in graphs.items() for (u, v), m in arcs.items()]
    return spark.createDataFrame(rows, "graph_id string, u string, v string, m long")
