"""Exact duplicates and vector codes against brute force, and their defined edge cases."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import exact_duplicates, vector_codes
from strandweave.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, first boolean, kept string, norm int, part int, `class` string"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def text_rows():
    rng = random.Random(3)
    head = "the same long beginning of many texts " * 4
    rows = [(i, rng.choice(["Hot copy", "hot COPY", "HOT copy"])) for i in range(700)]  # a group over many ranges
    rows += [(1000 + i, head + str(i % 60)) for i in range(240)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", "", None, " ", "É", "é", "ß", "SS", "ss", "a\x00b", "A\x00B", "日本", "x" * 300_000, "X" * 300_000, "x" * 299_999])]
    rows += [(5, "twice"), (5, "Twice"), (5, "TWICE"), (None, "twice"), (None, "no id"), (None, "No id"), (7, "no id too")]
    rng.shuffle(rows)
    return [(d, t, True, "k", 1, 2, "c") for d, t in rows]


def brute_copies(rows, keep):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lowered(t)].append(d)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        stays = True
        for d in sorted(ids, key=lambda i: i != best):
            out.append((-1 if d is None else d, -1 if best is None else best, len(ids), stays and d == best, sha))
            stays = stays and d != best
    return sorted(out)


def found_copies(df, **kw):
    got = exact_duplicates.exact_duplicates(df, **kw)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], *r[2:]) for r in got.collect())


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_copies_equal_brute_force(spark, ranges, keep):
    rows = text_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found_copies(df, keep=keep) == brute_copies(rows, keep)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_hash_that_says_nothing_changes_no_class(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(exact_duplicates, "TaskContext", Task)
    texts = sorted(lowered(t).encode() for _, t, *_ in text_rows())
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(lo, lo + len(part))), "head": [t[:4] for t in part], "hash": [0] * len(part), "norm": part}) for lo in range(0, len(texts), 7) for part in [texts[lo : lo + 7]]]
    rows = [r for b in exact_duplicates._runs(iter(batches)) for r in b.to_pylist()]
    groups = defaultdict(list)
    for r in rows:
        if r["kind"] == exact_duplicates.ROW:
            groups[r["run"]].append(texts[r["doc_id"]])
    assert sorted(groups) == list(range(len(set(texts)))) and all(len(set(g)) == 1 for g in groups.values())
    runs = {r["run"]: r for r in rows if r["kind"] == exact_duplicates.RUN}
    assert all(runs[k]["n"] == len(g) and runs[k]["sha"] == hashlib.sha256(g[0]).hexdigest() for k, g in groups.items())
    assert [r["norm"] for r in rows if r["kind"] in (exact_duplicates.FIRST, exact_duplicates.LAST)] == [texts[0], texts[-1]]


def test_copies_of_nothing_and_names(spark):
    assert exact_duplicates.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(3, "A"), (4, "a")], "key int, body string")
    assert found_copies(df, id_column="key", text_column="body") == brute_copies([(3, "a"), (4, "a")], "smallest")
    with pytest.raises(ValueError):
        exact_duplicates.exact_duplicates(df, "key", "body", keep="any")


# ------------------------------------------------------------ vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error) of a full scan in every round, in Python integers."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    ok = [r for r in rows if r[1] is not None and None not in r[1] and all(map(math.isfinite, r[1]))]
    usable = sorted((r for r in ok if r[1] and len(r[1]) % parts == 0), key=key)
    if not usable:
        return [], []
    dim = len(usable[0][1])
    usable = [r for r in usable if len(r[1]) == dim]
    width = dim // parts
    cut = lambda v: [[math.floor(scale * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)]
    cuts = [cut(r[1]) for r in usable]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, a: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cuts:
                held[nearest(p, c[p])].append(c[p])
            for e, mine in held.items():
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (vec_id, _, label), c in zip(usable, cuts):
        codes = [nearest(p, c[p]) for p in range(parts)]
        out.append((vec_id, label, "".join(f"{e:02x}" for e in codes), sum(far(c[p], books[p][e]) for p, e in enumerate(codes))))
    return out, books


def key(r):
    return tuple((x is None, x or 0) for x in r)


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(int(i), [round(x, 2) for x in rng.standard_normal(16).tolist()], int(i) % 3 or None) for i in rng.permutation(300)]
    rows += [(400 + i, [float(x) for x in rng.integers(-1, 2, 16)], 9) for i in range(200)]  # ties
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None), (-3, rows[2][1], None), (-4, rows[2][1], None)]
    rows += [(-9, None, 1), (-9, [1.0] * 15 + [None], 1), (-9, [math.nan] * 16, 1), (-9, [math.inf] * 16, 1), (-9, [1.0] * 15, 1), (-9, [], 1), (9, [1.0] * 8, 1)]
    return rows


@pytest.mark.parametrize("block,entries,rounds", [(7, 16, 6), (64, 3, 2), (64, 1, 1), (64, 16, 0)])
def test_codes_equal_a_full_scan(spark, monkeypatch, block, entries, rounds):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, q int").repartition(3)
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    coded, books = vector_codes.compress(df, 8, entries, rounds)
    want, plain = plain_codes(rows, 8, entries, rounds, 4096)
    assert books.tolist() == plain
    assert sorted((tuple(r) for r in coded.collect()), key=key) == sorted(want, key=key)
    errors = defaultdict(int)
    for r in want:
        errors[r[1]] += r[3]
    for share in (0.001, 0.3, 2.0):
        monkeypatch.setattr(vector_codes, "SHARE", share)
        got = vector_codes.label_errors(coded).collect()
        assert len(got) == len(want) and all(r["label_error"] == errors[r["label"]] for r in got)


def test_bounds_spare_full_scans_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (12, 8))
    q = (centres[rng.integers(0, 12, 5000)] + rng.integers(-90, 90, (5000, 8))).astype(np.int32)
    entries = q[:16].astype(np.int64)
    book, state, scanned = vector_codes.Book(entries), (None, None, None), []
    for _ in range(8):
        *state, n = book.assign(q, *state)
        scanned.append(n)
        far = vector_codes.distances(q, book.entries)
        assert (state[0] == far.argmin(axis=1)).all()
        own = np.sqrt(far[np.arange(len(q)), state[0]].astype(float))
        far[np.arange(len(q)), state[0]] = np.iinfo(np.int64).max
        assert (state[1] >= own).all() and (state[2] <= np.sqrt(far.min(axis=1).astype(float))).all()
        moved = np.array([q[state[0] == e].astype(np.int64).sum(axis=0) // max(1, (state[0] == e).sum()) if (state[0] == e).any() else book.entries[e] for e in range(16)])
        book = vector_codes.Book(moved, book.entries)
    assert scanned[0] == 5000 and scanned[-1] < 500


def test_codes_of_nothing_and_of_large_components(spark):
    kind = "vec_id long, embedding array<double>, label string"
    coded, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    assert vector_codes.label_errors(coded).count() == 0
    with pytest.raises(Exception, match="62 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, "a")], kind))
    coded, _ = vector_codes.compress(spark.createDataFrame([(1, [5e4] * 8, "a"), (2, [-5e4] * 8, None)], kind), entries=1, rounds=1)
    assert [r["error"] for r in coded.orderBy("vec_id").collect()] == [8 * 204800000**2] * 2


@pytest.mark.parametrize("name", ["op11_exact_duplicates", "op12_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
