"""URL filters, token counts, WARC fixity and vector searches."""

import math
import random
from fnmatch import fnmatchcase

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import token_counts, url_filters, vectors, warc
from strandweave.llm.url_filters import Automaton, Rule

# ------------------------------------------------------------ URL filters


def test_automaton_equals_fnmatch_on_many_globs():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?c") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "a" * 5000]
    raw = [t.encode() for t in texts]
    got = Automaton(globs).match(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == fnmatchcase(t, g), (t, g)


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for r in rules:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "nonsense", "http://", "http://NET/", "http://a.net", "http://a.net/", "https://x.Example.NET/en/1?q=://", "http://example.net/english", "http://evil.com/a.net/", "http://xexample.net/en/", "ftp://b.example.com/de/#x", "http://example.com?/de/", "http://o.org/fr/", "http://o.org/fr", "http://é.net/", "http://a.net/" + "y" * 9000, "http://" + "a." * 4000 + "net/x", "http://a.net/", "http://a.org//fr/", "://net/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://a.net/", "h", "r")], "page_id long, url string, host string, rule string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, url_filters.RULES).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        assert got[i] == plain(u, url_filters.RULES), u
    assert url_filters.filter_urls(df.where("false"), url_filters.RULES).count() == 0
    many = [Rule(f"h{i}.example/{'p' * i}/", "block") for i in range(80)]
    row = url_filters.filter_urls(spark.createDataFrame([(1, "http://h70.example/" + "p" * 70 + "/x")], "page_id long, url string"), many).first()
    assert row["rule"] == many[70].text


# ------------------------------------------------------------ token counts


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", None), ("t", "de", "v1", 3)], "source string, lang string, tokenizer string, tokens long")
    r = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    assert r.totals().count() == 0
    assert r.apply("a/1", token_counts.inserts(rows)) and not r.apply("a/1", token_counts.inserts(rows))
    as_set = lambda: {tuple(x) for x in r.totals().collect()}
    assert as_set() == {("s", "en", "v1", 2, 12), (None, None, "v1", 1, 0), ("t", "de", "v1", 1, 3)}
    r.apply("b", token_counts.deletes(rows.where("source = 't'")))
    r.apply("c", token_counts.revisions(rows.where("tokens = 7").withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.lit(1))))
    r.apply("none", token_counts.inserts(rows.where("false")))
    want = {("s", "en", "v1", 2, 6), (None, None, "v1", 1, 0)}
    assert as_set() == want
    r.compact()
    assert as_set() == want and not r.apply("b", token_counts.inserts(rows)) and as_set() == want


def one_row(spark, n=1):
    return token_counts.inserts(spark.createDataFrame([("s", "en", "v", n)], "source string, lang string, tokenizer string, tokens long"))


def test_rollup_of_many_long_ids(spark, tmp_path, monkeypatch):
    r = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    written = r._write(one_row(spark))
    monkeypatch.setattr(r, "_write", lambda delta: written)  # the same folder again: only publishing is tested at length
    ids = [f"2026-01-01T00:00:00/{'x' * 60}/{i}" for i in range(60)]
    for i in ids[:-1]:
        assert r.apply(i, one_row(spark))
    assert all(map(r._latest()[1]["batches"].__contains__, ids[:-1])) and not r.committed(ids[-1])
    monkeypatch.undo()
    before = len(r._latest()[1]["parts"])
    assert before == 59 and r.apply(ids[-1], one_row(spark, 5))
    r.compact()
    r.vacuum()
    assert len(r._latest()[1]["parts"]) == 1 and len(r._names("versions")) == 1
    assert [tuple(x) for x in r.totals().collect()] and not r.apply(ids[3], one_row(spark)) and not r.apply(ids[-1], one_row(spark))


def test_rollup_survives_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch):
    r = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    totals = lambda: [tuple(x)[3:] for x in r.totals().collect()]
    r.apply("a", one_row(spark, 1))
    r.apply("b", one_row(spark, 2))

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    publish = type(r)._publish
    for run, name, after, done in [(lambda: r.apply("c", one_row(spark, 4)), "_write", False, False), (lambda: r.apply("c", one_row(spark, 4)), "_publish", False, False), (r.compact, "_write", False, False), (r.compact, "_publish", False, False), (lambda: r.apply("c", one_row(spark, 4)), "_publish", True, True), (r.compact, "_publish", True, True)]:
        with monkeypatch.context() as m:
            m.setattr(r, name, (lambda *a: (publish(r, *a), crash())) if after else crash)
            with pytest.raises(Crash):
                run()
        assert totals() == ([(3, 7)] if done else [(2, 3)])
    assert not r.apply("c", one_row(spark, 4)) and len(r._latest()[1]["parts"]) == 1
    r.vacuum()
    assert totals() == [(3, 7)]


def test_two_writers_commit_each_batch_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "rollup")
    writers = [token_counts.TokenRollup(spark, path) for _ in range(2)]
    with ThreadPoolExecutor(4) as pool:
        applied = list(pool.map(lambda i: writers[i % 2].apply(f"b{i // 2}", one_row(spark, 1)), range(12)))
    assert sum(applied) == 6
    assert [tuple(x)[3:] for x in writers[0].totals().collect()] == [(6, 6)]


def test_counts_of_a_public_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "It's 12 o'clock", "x" * 5000, "a b  c"]
    df = spark.createDataFrame([(i, t, "s", None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in token_counts.tokenizer_counts(df, path, "bpe").collect()}
    coder = Tokenizer.from_file(path)
    assert got == {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    empty = token_counts.tokenizer_counts(df.where("false"), path, "bpe")
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "lang", "tokenizer", "tokens"]


def test_document_counts_of_odd_rows(spark):
    rows = [(1, "a b1", "s", "en", 7), (1, "a b1", "s", "en", 7), (None, None, None, None, 7), (2, "", "s", None, 7), (3, "w " * 100_000, "t", "en", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, words int")
    got = sorted((tuple(r) for r in token_counts.document_counts(df).collect()), key=str)
    assert got == sorted([(1, "s", "en", 2, 2), (1, "s", "en", 2, 2), (None, None, None, 0, 0), (2, "s", None, 0, 0), (3, "t", "en", 100_000, 100_000)], key=str)
    assert token_counts.document_counts(df.where("false")).count() == 0


# ------------------------------------------------------------ WARC


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 50) + str(i)) for i in range(700)] + [(None, None, None), (5, "http://h/5", "x" * 5 + "5"), (6, None, ""), (701, "u", "y" * 200_000)]
    return warc.indexed(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)))


def test_offsets_are_gapless(made):
    by_file = {}
    for r in sorted(made.collect(), key=lambda r: (r["file"], r["ordinal"])):
        at, n = by_file.get(r["file"], (0, 0))
        assert (r["offset"], r["ordinal"]) == (at, n) and r["length"] == len(r["record"].encode())
        by_file[r["file"]] = (at + r["length"], n + 1)


def test_one_page_id_for_most_records_and_clashing_names(spark):
    pages = [(7, f"u{i % 900}", "h" * (i % 13), "f", i, "d") for i in range(2500)] + [(i, "v", None, "f", 1, "d") for i in range(100)] + [(None, f"n{i % 3}", "x", "f", 2, "d") for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, file string, ordinal int, digest string").repartition(5)
    rows = warc.indexed(warc.records(df).select("page_id", "file", "length", "digest")).collect()
    assert len(rows) == len(pages)
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    for own in by_file.values():
        own.sort(key=lambda r: r["ordinal"])
        assert [(r["page_id"] or 0, r["digest"]) for r in own] == sorted((r["page_id"] or 0, r["digest"]) for r in own)
        at = 0
        for n, r in enumerate(own):
            assert (r["ordinal"], r["offset"]) == (n, at)
            at += r["length"]


def test_audit_finds_exactly_what_differs(spark, made):
    base = warc.leaves(made)
    assert warc.audit(base, base).count() == 0
    hurt = base.withColumn("digest", F.when(F.col("ordinal") == 3, "zz").otherwise(F.col("digest"))).where("not (file = 2 and ordinal = 100)")
    extra = hurt.unionByName(spark.createDataFrame([(1, 5000, 9, 9, "e")], hurt.schema))
    got = {(r["file"], r["ordinal"], r["status"]) for r in warc.audit(base, extra, fanout=4).collect()}
    want = {(r["file"], 3, "corrupt") for r in base.where("ordinal = 3").collect()} | {(2, 100, "missing"), (1, 5000, "extra")}
    assert got == want
    assert warc.audit(base.where("false"), base.where("false")).count() == 0
    assert warc.audit(base, base.where("false")).where("status = 'missing'").count() == base.count()


# ------------------------------------------------------------ vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).astype(float).tolist(), "r") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "r") for i in range(20)]  # ties
    rows += [(50, rows[7][1], "r"), (2000, None, "r"), (2050, [], "r"), (2100, [0.0] * 16, "r"), (2150, [math.nan] * 16, "r"), (2200, [math.inf] + [0.0] * 15, "r"), (2250, [None] + [1.0] * 15, "r"), (2300, [1.0, 2.0], "r"), (2301, [1.0, 2.5], "r"), (None, rows[8][1], "r")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3), rows


def brute(rows, every, k, score, zero):
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))]
    out = []
    for i, q in ok:
        if i % every == 0:
            hits = sorted((-score(q, v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_exact_top_k_equals_brute_force(points):
    df, rows = points
    got = sorted(tuple(r) for r in vectors.exact_top_k(df, vectors.query_rows(df, 50), 5).collect())
    assert got == brute(rows, 50, 5, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()), True)
    assert vectors.exact_top_k(df.where("false"), df.where("false")).count() == 0


def test_nearest_reaches_its_recall_with_exact_scores(points):
    df, rows = points
    got = sorted(tuple(r) for r in vectors.nearest(df, vectors.query_rows(df, 50), 5).collect())
    want = brute(rows, 50, 5, lambda a, b: float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))), False)
    assert len(got) == len(want)
    same = {(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}
    assert len(same) >= 0.95 * len({(a, c) for a, _, c, _ in want})
    truth = {i: np.array(v) for i, v, _ in rows if v}
    for q, _, j, s in got:
        if q != 50:
            a, b = truth[q], truth[j]
            assert abs(s - float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))) < 1e-12


def test_small_blocks_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 1e5).tolist(), "r") for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(2)
    got = sorted(tuple(r) for r in vectors.exact_top_k(df, vectors.query_rows(df, 10), 4).collect())
    assert got == brute(rows, 10, 4, lambda a, b: sum(int(x) * int(y) for x, y in zip(np.floor(256 * a), np.floor(256 * b))), True)


@pytest.mark.parametrize("size", [1e3, 1e5, 1e6, 1e7, 1e9])
def test_outliers_lose_no_neighbour(size):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((30, 64))
    m = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.standard_normal((3000, 64))
    m[[905, 900]] *= size
    ids = np.arange(len(m))
    for sample in (m, m[[905, 900]], m[[0, 1, 2, 905, 900]]):
        method = vectors.Pivots(5, vectors.Pivots.far_points({64: sample}), step=32)
        best = vectors.Best(60, 5, np.int64)
        method.meet(method.asked(m[:60]), m[:60], ids[:60], m, ids, [x.tobytes() for x in method.table(m)], best)
        exact = np.array(vectors.quantised(m[:60]).astype(np.int64) @ vectors.quantised(m).T.astype(np.int64))
        for i in range(60):
            others = np.delete(ids, i)
            assert best.keys[i].tolist() == others[np.lexsort((others, -exact[i, others]))[:5]].tolist()


def test_very_far_rows_are_exact_as_long_as_scores_fit(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(8).tolist(), "r") for i in range(1, 300)] + [(1000, (rng.standard_normal(8) * 1e9).tolist(), "r"), (1001, (rng.standard_normal(8) * 1e11).tolist(), "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(2)
    asked = df.where("vec_id < 40")
    got = sorted(tuple(r) for r in vectors.exact_top_k(df, asked, 5).collect())
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(np.floor(256 * a), np.floor(256 * b)))
    assert got == [r for r in brute(rows, 1, 5, score, True) if r[0] < 40]
    with pytest.raises(Exception, match="63 bits"):
        vectors.exact_top_k(df, df.where("vec_id > 1000"), 5).collect()


def test_cosines_of_vectors_of_extreme_size(spark):
    rng = np.random.default_rng(13)
    plain = [rng.standard_normal(8).tolist() for _ in range(60)]
    rows = [(i, [x * 10.0 ** [0, 200, -200, 307][i % 4] for x in v], "r") for i, v in enumerate(plain)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in vectors.nearest(df, df.where("vec_id % 5 = 0"), 4).collect())
    want = brute([(i, v, "r") for i, v in enumerate(plain)], 5, 4, lambda a, b: float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))), False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-12


def test_rows_that_repeat_a_query_hide_no_neighbour(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), "r") for i in range(1, 60)]
    rows += [(0, [3.0] * 8, "r")] * 10 + [(100 + i, [2.0 + i / 10] * 7 + [1.0], "r") for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").coalesce(1)
    asked = df.where("vec_id = 0")
    got = sorted(tuple(r) for r in vectors.exact_top_k(df, asked, 5).collect())
    assert got == brute(rows, 1000, 5, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()), True)
    near = sorted(tuple(r)[:3] for r in vectors.nearest(df, asked, 5).collect())
    want = brute(rows, 1000, 5, lambda a, b: float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))), False)
    assert len(near) == 50 and near == [w[:3] for w in want]


def test_queries_in_several_chunks(spark, monkeypatch, points):
    df, rows = points
    monkeypatch.setattr(vectors, "CHUNK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    got = sorted(tuple(r) for r in vectors.exact_top_k(df, vectors.query_rows(df, 50), 5).collect())
    assert got == brute(rows, 50, 5, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()), True)


def test_shares_evaluated_and_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in vectors.nearest(table, vectors.query_rows(table, 50), 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    pdf = table.toPandas()
    ids, m = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
    unit, asking = m / np.linalg.norm(m, axis=1)[:, None], ids % 50 == 0
    found = 0
    for i in np.flatnonzero(asking):
        cosines = np.where(ids == ids[i], -2, unit @ unit[i])
        found += len(got[ids[i]] & set(ids[np.lexsort((ids, -cosines))[:5]]))
    assert found >= 0.9 * 5 * asking.sum()
    # codes leave few rows to be scored; of clustered rows, pivots leave few too
    best = vectors.Best(int(asking.sum()), 5, float)
    method = vectors.OneBit(5)
    scored = method.meet(method.asked(m[asking]), m[asking], ids[asking], m, ids, [x.tobytes() for x in method.table(m)], best)
    assert scored < 0.25 * asking.sum() * len(m)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    near = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.standard_normal((4000, 32))
    pivots = vectors.Pivots(5, vectors.Pivots.far_points({32: near[:1000]}), step=64)
    best = vectors.Best(50, 5, np.int64)
    scored = pivots.meet(pivots.asked(near[:50]), near[:50], np.arange(50), near, np.arange(4000), [x.tobytes() for x in pivots.table(near)], best)
    assert scored < 0.3 * 50 * 4000
    exact = vectors.quantised(near[:50]) @ vectors.quantised(near).T
    for i in range(50):
        exact[i, i] = -np.inf
        assert best.keys[i].tolist() == np.lexsort((np.arange(4000), -exact[i]))[:5].tolist()
