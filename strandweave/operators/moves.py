"""Moves between reconstructions: rotors, samplers, inversions, transpositions, closures.

The kernels act on one graph or word; closures over many words run as
semi-naive fixpoints on DataFrames.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequences import least_rotation
from strandweave.operators import exact
from strandweave.operators.counting import Cover, arborescences, rc, reduced_laplacian, vertices
from strandweave.session import Scratch

# ---------------------------------------------------------------- rotors


def out_arcs(arcs: Counter) -> dict:
    """Ordered labelled out-arcs (head, copy) of each vertex."""
    out = defaultdict(list)
    for (u, v), m in sorted(arcs.items()):
        out[u] += [(v, i) for i in range(m)]
    return dict(out)


def route(arcs: Counter, root, rotors: dict, start, most: int = 10**7) -> dict:
    """Drop a chip at ``start``: each visit advances the vertex's rotor and follows it, until the root."""
    out, rotors, x = out_arcs(arcs), dict(rotors), start
    for _ in range(most):
        if x == root:
            return rotors
        rotors[x] = (rotors[x] + 1) % len(out[x])
        x = out[x][rotors[x]][0]
    raise RuntimeError("the chip did not reach the root")


def act(arcs: Counter, root, rotors: dict, chips: dict) -> dict:
    """Rotor state after routing all chips of a configuration."""
    for v in sorted(chips):
        for _ in range(chips[v]):
            rotors = route(arcs, root, rotors, v)
    return rotors


def tree_rotors(arcs: Counter, root) -> list[dict]:
    """Rotor states (index of the chosen out-arc) that are arborescences to the root."""
    out = out_arcs(arcs)
    return [{v: out[v].index(a) for v, a in t.items()} for t in arborescences(arcs, root)]


def orbit_of(arcs: Counter, root, rotors: dict) -> set[tuple]:
    """All rotor states reached from one by chips at any vertices."""
    seen, todo = set(), [rotors]
    while todo:
        r = todo.pop()
        key = tuple(sorted(r.items()))
        if key not in seen:
            seen.add(key)
            todo += [route(arcs, root, r, v) for v in r]
    return seen


def tree_circuit(arcs: Counter, root, tree: dict, order: dict | None = None) -> list[tuple]:
    """BEST bijection: the Eulerian circuit from the root that leaves each vertex by its tree arc last.

    ``order`` gives, for a vertex, the sequence of its other out-arcs.
    """
    left = {}
    for v, own in out_arcs(arcs).items():
        rest = [a for a in own if v == root or a != tree[v]]
        rest = [rest[i] for i in order[v]] if order and v in order else rest
        left[v] = (rest + ([] if v == root else [tree[v]]))[::-1]
    x, walk = root, []
    while left.get(x):
        head, copy = left[x].pop()
        walk.append((x, head, copy))
        x = head
    return walk


def wilson_tree(arcs: Counter, root, rng: random.Random) -> dict:
    """Uniform random arborescence to the root by loop-erased random walks."""
    out, tree, done = out_arcs(arcs), {}, {root}
    for v in sorted(out):
        x = v
        while x not in done:
            tree[x] = rng.choice(out[x])
            x = tree[x][0]
        x = v
        while x not in done:
            done.add(x)
            x = tree[x][0]
    return {v: tree[v] for v in tree if v != root}


def group_sampler(arcs: Counter, root, rng: random.Random) -> dict:
    """Chips of a uniform random element of the critical group, from independent residues in Smith coordinates."""
    names = [v for v in vertices(arcs) if v != root]
    # rows of the Laplacian are the firing moves; P L Q = diag, classes of Z^n / rows are seen through Q
    diagonal, _, q = exact.smith_diagonal(reduced_laplacian(arcs, root), track=True)
    residues = [rng.randrange(d) for d in diagonal]
    # a vector x with x Q congruent to the residues: x = residues * Q^-1
    inverse_columns = [exact.solve([list(r) for r in q], [int(i == j) for j in range(len(q))]) for i in range(len(q))]
    chips = [sum(int(r) * int(c[j]) for r, c in zip(residues, inverse_columns)) for j in range(len(names))]
    return normalise_chips(arcs, root, dict(zip(names, chips)))


def normalise_chips(arcs: Counter, root, chips: dict) -> dict:
    """An equivalent configuration without negative entries (adds multiples of the group order)."""
    from strandweave.operators.counting import tree_count

    order = tree_count(arcs, root)
    return {v: c % order for v, c in chips.items()}


def generated(permutations: list[tuple[int, ...]]) -> set[tuple[int, ...]]:
    """The group that permutations generate."""
    one = tuple(range(len(permutations[0])))
    seen, todo = {one}, [one]
    while todo:
        p = todo.pop()
        for g in permutations:
            q = tuple(g[i] for i in p)
            if q not in seen:
                seen.add(q)
                todo.append(q)
    return seen


# ---------------------------------------------------------------- words


def canonical(s: str) -> str:
    return min(s[i:] + s[:i] for i in range(len(s))) if s else s


def double_spectrum(s: str, k: int) -> Counter:
    """Words of both strands of a circular sequence."""
    count = Counter()
    for t in (s, rc(s)):
        count.update((t + t[: k - 1])[i : i + k] for i in range(len(t)))
    return count


def inversions(s: str, k: int) -> set[str]:
    """Cyclic words reached by reversing a segment w X rc(w), w of k letters: w rc(X) rc(w)."""
    n, found = len(s), set()
    t = s + s
    at = defaultdict(list)
    for i in range(n):
        at[t[i : i + k]].append(i)
    for w, starts in at.items():
        for i in starts:
            for j in at.get(rc(w), ()):
                gap = (j - i) % n
                if k <= gap <= n - k:
                    turned = t[i : i + n]
                    found.add(canonical(w + rc(turned[k:gap]) + turned[gap:]))
    return found


def transpositions(s: str, k: int) -> set[str]:
    """Cyclic words reached by exchanging two segments between interlaced repeats x y x y, or three at one repeat."""
    n, found = len(s), set()
    t = s + s
    at = defaultdict(list)
    for i in range(n):
        at[t[i : i + k]].append(i)
    pairs = [(w, i, j) for w, p in at.items() for a, i in enumerate(p) for j in p[a + 1 :]]
    for x, (v, a, c) in enumerate(pairs):
        for w, b, d in pairs[x + 1 :]:
            if v != w and (a < b < c) != (a < d < c):
                cuts = sorted((a, b, c, d))
                p, q, r, u = (t[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], cuts[0] + n]))
                found.add(canonical(r + q + p + u))
    for p in at.values():
        for a, i in enumerate(p):
            for b, j in enumerate(p[a + 1 :], a + 1):
                for h in p[b + 1 :]:
                    found.add(canonical(t[j:h] + t[i:j] + t[h : i + n]))
    return found


def reversal(s: str, k: int) -> set[str]:
    """The cyclic word read on its other strand."""
    return {canonical(rc(s))}


MOVES = (inversions, transpositions, reversal)


def closure(start: str, k: int, moves: tuple[Callable[[str, int], set[str]], ...] = MOVES, cap: int = 200_000) -> set[str] | None:
    """All cyclic words reached by moves from one word; None beyond the cap."""
    first = canonical(start)
    seen, todo = {first}, [first]
    while todo:
        s = todo.pop()
        for move in moves:
            for t in move(s, k):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
                    if len(seen) > cap:
                        return None
    return seen


def reconstructions(s: str, k: int) -> set[str]:
    """Cyclic words with the same double-stranded (k+1)-word counts, by exhaustion."""
    target = double_spectrum(s, k + 1)
    words = sorted(target)
    n, found = len(s), set()

    def grow(t: str, left: Counter):
        if len(t) == n:
            tail = (t + t)[n - k :][: 2 * k]
            rest = left.copy()
            for i in range(k):
                w = tail[i : i + k + 1]
                for x in (w, rc(w)):
                    rest[x] -= 1
            if all(v == 0 for v in rest.values()):
                found.add(canonical(t))
            return
        for c in "ACGT":
            w = t[-k:] + c
            now = left.copy()
            now[w] -= 1
            now[rc(w)] -= 1
            if now[w] >= 0 and now[rc(w)] >= 0:
                grow(t + c, now)

    for w in words:
        left = target.copy()
        left[w] -= 1
        left[rc(w)] -= 1
        if left[w] >= 0 and left[rc(w)] >= 0:
            grow(w, left)
    return found


def flip_distances(start: str, k: int, cap: int = 200_000) -> dict[str, int] | None:
    """Number of inversions from a word to each word that inversions reach."""
    level, seen = {canonical(start)}, {canonical(start): 0}
    step = 0
    while level:
        step += 1
        level = {t for s in level for t in inversions(s, k)} - seen.keys()
        seen |= dict.fromkeys(level, step)
        if len(seen) > cap:
            return None
    return seen


def valid_tour(cover: Cover, tour: list[str]) -> bool:
    """Whether a cyclic list of contents is a reconstruction: ends meet and each content with its partner is used m times."""
    if not all(cover.ends.get(a, (0, 0))[1] == cover.ends.get(b, (1, 1))[0] for a, b in zip(tour, tour[1:] + tour[:1])):
        return False
    used = Counter(tour)
    return all(used[a] + used[rc(a)] == cover.m[a] * (1 if a != rc(a) else 1) if a != rc(a) else 2 * used[a] == cover.m[a] for a in cover.m)


# ---------------------------------------------------------------- closures as fixpoints


def closures(words: DataFrame, k: int, moves: tuple = MOVES, rounds: int = 1000) -> DataFrame:
    """(seq_id, word, distance): everything that moves reach from each cyclic word, level by level.

    Each round expands only the newest words and leaves out what has been seen;
    levels are written to the shared folder.  More than ``rounds`` levels are an error.
    """
    scratch = Scratch(words.sparkSession, "closures")
    kind = words.schema["seq_id"].dataType.simpleString()

    def expand(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(i, t) for i, s in zip(pdf["seq_id"], pdf["word"]) for move in moves for t in move(s, k)]
            yield pd.DataFrame(rows, columns=["seq_id", "word"])

    level = words.select("seq_id", least_rotation("seq").alias("word")).withColumn("distance", F.lit(0))
    seen = scratch.save(level, "0")
    level = seen
    for step in range(1, rounds + 1):
        reached = level.select("seq_id", "word").mapInPandas(expand, f"seq_id {kind}, word string").distinct()
        level = scratch.save(reached.join(seen, ["seq_id", "word"], "left_anti").withColumn("distance", F.lit(step)), str(step))
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)
    raise RuntimeError(f"closures: still growing after {rounds} rounds")
