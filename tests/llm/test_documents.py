"""Operators over documents against plain versions, and their defined edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strandweave.llm import language, mixing, near_duplicates, packing, quality, text as tx  # noqa: E402
from strandweave.llm.tokens import WordEncoder  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tokens string, score string, `_mix` string, key long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñü") for _ in range(rng.randint(1, 9)))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(120)] = word()
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one"), (205, "One two"), (206, "12 34"), (207, "日本語 テキスト"), (208, "a\x00b c"), (None, "one two three four"), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(300, " ".join(word() for _ in range(60_000))), (301, "x" * 300_000)]
    return [(d, t, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s0", "s1", None]), 1, "n", "t", "s", "m", 5) for d, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(t, width):
    w = word_list(t)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


# ------------------------------------------------------------ packing


def plain_ids(texts, specials_as_text=False):
    fresh = Tokenizer.from_file(TOKENIZER)
    if specials_as_text:
        fresh.encode_special_tokens = True
    return [fresh.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("specials_as_text", [False, True])
def test_word_encoder_equals_a_fresh_tokenizer(specials_as_text):
    coder = WordEncoder(TOKENIZER, True, specials_as_text)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["It's 12½ o'clock—we'LL see!!! ÀÉÞ ß µ", "<|endoftext|> x", "a b\u0085c", "é", "ΑΣ ΑΣ"]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<| endoftext |>", "日本<|endoftext|>"]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == plain_ids(texts, specials_as_text)


def check_packing(docs, length, specials_as_text=False):
    want = Counter()
    rows = docs.select("doc_id", "text").collect()
    for r, ids in zip(rows, plain_ids([r[1] or "" for r in rows], specials_as_text)):
        want[(r[0], np.array([*ids, 2], "<u4").tobytes())] += 1
    pieces = packing.pack(docs, TOKENIZER, length=length, width=max(1, length // 32), with_ids=True, specials_as_text=specials_as_text).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        raw = np.array(p["ids"], "<u4").tobytes()
        assert p["length"] == len(p["ids"]) > 0 and zlib.crc32(raw) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    held = padded = 0
    for cells in by_sequence.values():
        at = 0
        for offset, n in sorted(cells):
            assert offset == at
            at += n
        assert at <= length
        held += at
        padded += 0 if at & (at - 1) == 0 else length - at
    # the pieces of equal documents are interchangeable: rebuild by (doc_id, start)
    lots = defaultdict(list)
    for p in pieces:
        lots[(p["doc_id"], p["doc_tokens"])].append((p["start"], np.array(p["ids"], "<u4").tobytes()))
    total = 0
    for (doc_id, n), parts in lots.items():
        same = [(raw, c) for (d, raw), c in want.items() if d == doc_id and len(raw) == 4 * n]
        assert sum(len(b) for _, b in parts) == sum(len(raw) * c for raw, c in same)
        if len(same) == 1:
            assert all(same[0][0][4 * s : 4 * s + len(b)] == b for s, b in parts)
        total += sum(c for _, c in same)
    assert total == sum(want.values())
    assert held == sum(len(raw) // 4 * c for (_, raw), c in want.items())
    return padded


@pytest.mark.parametrize("length", [4096, 64])
def test_packing_keeps_every_token_without_padding(odd, length):
    assert check_packing(odd, length) == 0


@pytest.mark.parametrize("specials_as_text", [False, True])
def test_packing_of_texts_that_hold_special_strings(spark, specials_as_text):
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "<|endoftext|>" * 70, "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check_packing(docs, 64, specials_as_text) == 0


def test_packing_of_nothing(none):
    assert packing.pack(none, TOKENIZER).count() == 0


def test_column_generation_reaches_the_known_optimum():
    # stocks of 10: 4 of size 6 with 4 of size 4, 3 of size 5 in pairs
    patterns, counts = packing.column_generation(np.array([4.0, 3.0, 4.0]), np.array([4, 5, 6]), 10)
    assert abs(counts.sum() - 5.5) < 1e-9
    assert np.allclose(patterns @ counts, [4, 3, 4]) and (np.array([4, 5, 6]) @ patterns <= 10).all()


# ------------------------------------------------------------ near duplicates


def brute_classes(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("width,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(odd, width, num, den):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    got = near_duplicates.duplicate_classes(odd, width, (num, den)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows, width, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.duplicate_classes(df, 3, (85, 100)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows, 3, 85, 100)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_cells_alone_and_small_cells_find_every_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_duplicates, "CELL", 5)
    monkeypatch.setattr(near_duplicates, "LOAD", 400)
    rng = random.Random(rounds)
    rows = []
    for family in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for i in range(20):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
            rows.append((100 * family + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.duplicate_classes(df, 3, (85, 100), rounds=rounds).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows, 3, 85, 100)


def test_a_link_between_two_equally_large_classes_is_found():
    sets = [np.arange(0, 20), np.arange(100, 120), np.arange(200, 220), np.arange(200, 220)]
    run = lambda s: near_duplicates.linked(np.array([1, 2, 1, 2]), np.array([False, True, False, True]), np.ones(4, bool), np.concatenate(s), np.array([len(x) for x in s]), 85, 100).tolist()
    assert run(sets) in ([[1, 2]], [[2, 1]])
    assert run(sets[:3] + [np.arange(300, 320)]) == []


def test_one_row_of_each_class_stays(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(1, shared), (3, shared), (3, "quite another text than this one here"), (7, "alpha beta gamma delta epsilon zeta"), (7, "alpha beta gamma delta epsilon zeta"), (None, shared), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (9, ""), (9, ""), (10, None), (11, " \t")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, `_kept` int, _Doc string").repartition(3)
    out = near_duplicates.distinct_documents(df)
    assert out.columns == df.columns
    want = [(1, shared), (3, rows[2][1]), (7, rows[3][1]), (None, rows[6][1]), (9, ""), (9, ""), (10, None), (11, " \t")]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)
    # several texts of one id and class: one of them stays
    near = shared + " extra"
    again = spark.createDataFrame([(1, shared), (1, near), (1, near), (2, shared)], "doc_id long, text string")
    kept = near_duplicates.distinct_documents(again).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 1


def test_near_duplicates_of_nothing(none):
    assert near_duplicates.duplicate_classes(none).count() == 0
    assert near_duplicates.distinct_documents(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    low = near_duplicates.minima(np.concatenate([a, b]), np.array([len(a), len(b)]))
    s = near_duplicates.packed(low).view(np.uint64)
    equal = sum(((int(x) ^ int(y)) >> (4 * i)) & 15 == 0 for x, y in zip(s[0], s[1]) for i in range(16))
    assert abs((equal / near_duplicates.HASHES - 1 / 16) / (15 / 16) - 0.5) < 0.2


# ------------------------------------------------------------ classifiers


def test_statistics_do_not_depend_on_slices(odd):
    import pyarrow as pa

    texts = [r[1] for r in odd_rows()]
    column = pa.array(texts)
    whole = np.concatenate([quality.statistics(d, o) for _, _, d, o in tx.slices(column)])
    single = np.concatenate([quality.statistics(d, o) for t in texts for _, _, d, o in tx.slices(pa.array([t], pa.string()))])
    assert np.allclose(whole, single)


def test_trees_learn_and_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=30)
    p = forest.scores(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    nodes = len(forest.feature) // forest.trees
    for i in (2000, 2500):
        total = forest.base
        for t in range(forest.trees):
            at = t * nodes
            while forest.feature[at] >= 0:
                at = forest.left[at] + (x[i, forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        assert abs(1 / (1 + np.exp(-total)) - p[i - 2000]) < 1e-12


def test_quality_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i >= 100), 0, "x") for i in range(0, 160)] + [(7, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.score_quality(none, labels).count() == 0
    assert quality.score_quality(odd, labels.where("false")).where("score = 0.5").count() == odd.count()


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.quality_query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language.language_query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_language_edge_cases(odd, none):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_languages(odd).collect()}
    by_id = defaultdict(set)
    for d, lang, score in got:
        by_id[d].add((lang, score))
        assert 0 <= score <= 1 and lang in ("aa", "bb", "und")
    assert all(by_id[d] == {("und", 0.0)} for d in (200, 201, 202, 206))
    assert language.identify_languages(none).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_passages_count_each_gram_once(monkeypatch):
    t = "Größe und Maß " * 50
    whole = language.counts(t)
    monkeypatch.setattr(language, "PASSAGE", 37)
    assert (language.counts(t) == whole).all()


@pytest.mark.parametrize("n, block", [(400, 2), (700, 3), (40, 256), (0, 2)])
def test_prefix_sums_over_several_levels(spark, n, block):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, 4096), "r") for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, n), "item long, tail long, other string").repartition(3)
    got = packing.prefix_sums(df, "item", "tail", n, "lo", block)
    assert got.columns == [*df.columns, "lo"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, t, o, sum(x for _, x, _ in rows[:i])) for i, t, o in rows]


# ------------------------------------------------------------ mixing


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, k, 300) for k in (5, 4, 8)]
    w = rng.random(300) * 1000
    targets = [mixing.tempered(c, w, p) for c, p in zip(codes, (0.5, 0.7, 0.0))]
    raked = mixing.rake(codes, w, targets)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, raked, len(t)), t)
    p = mixing.probabilities(w, raked, 0.7)
    assert p.max() <= 1 and abs((p * w).sum() / w.sum() - 0.7) < 1e-6


def expected_shares(cells, found, d):
    sums = defaultdict(float)
    for *key, n in cells:
        sums[key[d]] += n * found[tuple(key)]
    return {v: x / sum(sums.values()) for v, x in sums.items()}, sum(sums.values())


@pytest.mark.parametrize("most", [1000, 0])
def test_the_expected_sample_meets_the_targets(spark, most):
    rng = random.Random(0)
    cells = [(a, b, c, int(10 ** rng.uniform(2, 3.5))) for a in ("s0", "s1", None) for b in ("en", "de") for c in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic long, tokens long")
    total = sum(c[3] for c in cells)
    run = lambda f, targets=None: {tuple(r)[:3]: r["probability"] for r in mixing.cell_probabilities(df, mixing.TEMPER, f, most, targets).collect()}
    found = run(0.6)
    assert max(found.values()) > 1 - 1e-9  # some cells are kept whole
    for d, name in enumerate(mixing.DIMENSIONS):
        own, kept = expected_shares(cells, found, d)
        given, _ = expected_shares(cells, dict.fromkeys(found, 1), d)
        tempered = {v: x ** mixing.TEMPER[name] for v, x in given.items()}
        assert abs(kept / total - 0.6) < 1e-6 and all(abs(own[v] - x / sum(tempered.values())) < 1e-4 for v, x in tempered.items())
    own, kept = expected_shares(cells, run(0.3, {"source": {"s0": 2, None: 1}}), 0)
    assert abs(kept / total - 0.3) < 1e-6 and all(abs(own[v] - x) < 1e-4 for v, x in {"s0": 2 / 3, "s1": 0, None: 1 / 3}.items())


def test_a_value_that_runs_out_is_kept_whole():
    assert np.allclose(mixing.reachable(np.array([1.0, 1, 2]), np.array([5.0, 100, 100]), 65), [5, 20, 40])


def test_slow_raking_stops_by_one_rule(spark, monkeypatch, caplog):
    cells = [("a", "x", 0, 1000), ("a", "y", 1, 10), ("b", "y", 0, 10), ("b", "y", 1, 1000), ("c", "x", 1, 30), ("c", "z", 2, 500)]
    df = spark.createDataFrame(cells, "source string, lang string, topic long, tokens long")
    run = lambda most, f: {tuple(r)[:3]: r["probability"] for r in mixing.cell_probabilities(df, {"source": 1, "lang": 0.5, "topic": 0.8}, f, most).collect()}
    monkeypatch.setattr(mixing.rake, "__defaults__", (40, 1e-10, None))
    monkeypatch.setattr(mixing._rake_table, "__defaults__", (40, 1e-10))
    told = []
    found = []
    for most in (1000, 0):
        caplog.clear()
        found.append(run(most, 0.6))
        told.append(sorted(r.getMessage() for r in caplog.records if "mixing" in r.getMessage()))
    assert all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])
    assert told[0] == told[1] and told[0]  # marginals that no sample can have together


@pytest.mark.filterwarnings("error")
def test_marginals_that_contradict_each_other_leave_finite_weights():
    codes = [np.array([0, 0, 1]), np.array([0, 1, 1])]
    raked = mixing.rake(codes, np.array([5.0, 5, 5]), [np.array([9.0, 6]), np.array([2.0, 13])], passes=3000, most=np.array([10.0, 8, 10]))
    assert np.isfinite(raked).all() and (raked <= [10, 8, 10]).all()
    raked = mixing.rake([np.array([0, 1]), np.array([0, 1])], np.array([5.0, 5]), [np.array([1.0, 9]), np.array([9.0, 1])], passes=3000, most=np.array([10.0, 8]))
    assert np.isfinite(raked).all()


def test_both_ways_of_raking_have_one_limit():
    import inspect

    a, b = (inspect.signature(f).parameters for f in (mixing.rake, mixing._rake_table))
    assert a["passes"].default == b["passes"].default and a["close"].default == b["close"].default


def test_mixing_edge_cases(odd, none):
    rows = mixing.mix(odd, column="_m").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["_m"]["tokens"] == len(word_list(r["text"])) and r["_mix"] == "m" and 0 <= r["_m"]["probability"] <= 1
        assert r["_m"]["kept"] or r["_m"]["tokens"]
    assert mixing.mix(none).count() == 0


def test_raking_as_a_table_equals_the_driver(spark):
    rng = random.Random(5)
    rows = [(a, b, c, rng.randint(100, 5000)) for a in ("s0", "s1", None) for b in ("en", "de") for c in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic long, tokens long")
    found = [{tuple(r)[:3]: r["probability"] for r in mixing.cell_probabilities(cells, mixing.TEMPER, 0.6, most).collect()} for most in (1000, 0)]
    assert found[0].keys() == found[1].keys() == {r[:3] for r in rows}
    assert all(abs(found[0][k] - found[1][k]) < 1e-6 for k in found[0])
