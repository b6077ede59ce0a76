"""The jobs: growing input, repeated and interrupted runs, odd rows, command lines; all on copies."""

import json
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import pool_spectra, repeat_atlas

SF = "/root/testdata/sf0.001"
K = 4


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text", "source")
    odd = [(10**6, None, "odd"), (10**6 + 1, "", "odd"), (10**6 + 2, "abc", "odd"), (10**6 + 3, "abcd" * 9, None), (10**6 + 4, "abcd efgh", None), (10**6 + 5, "日本 123", ""), (10**6 + 6, "aaaaaaaa", ""), (10**6 + 7, "x" * 50_000, "odd")]
    return [tuple(r) for r in base.collect()] + odd


def put(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.lit("x")).coalesce(1).write.mode("append").parquet(path)


def dna(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in (text or "").lower() if "a" <= c <= "z")


def plain_spectrum(rows):
    n, holders, members = Counter(), Counter(), Counter()
    for _, text, pool in rows:
        s = dna(text)
        if len(s) >= K:
            words = [(s + s[: K - 1])[i : i + K] for i in range(len(s))]
            members[pool] += 1
            n.update((pool, w) for w in words)
            holders.update((pool, w) for w in set(words))
    return {(p, w, c, holders[p, w], holders[p, w] == members[p], w[:2]) for (p, w), c in n.items()}


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def batches(spark, out):
    return {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/deltas").groupBy("batch").count().collect()}


def test_spectra_of_growing_input(spark, docs, tmp_path):
    sequences, out, mark = (str(tmp_path / n) for n in ("sequences", "out", "mark"))
    run = lambda: pool_spectra.run(spark, sequences, out, mark, K, files_per_batch=1)
    third = len(docs) // 3
    put(spark, docs[:third], sequences)
    run()
    assert result(pool_spectra.read(spark, out)) == plain_spectrum(docs[:third])
    first = batches(spark, out)
    run()  # nothing new
    assert batches(spark, out) == first and result(pool_spectra.read(spark, out)) == plain_spectrum(docs[:third])
    put(spark, docs[third : 2 * third], sequences)
    put(spark, docs[2 * third :], sequences)
    run()
    assert batches(spark, out).items() > first.items() and len(batches(spark, out)) == 3
    assert result(pool_spectra.read(spark, out)) == plain_spectrum(docs)
    assert {p.name for p in Path(out, "spectrum").iterdir() if p.is_dir()} == {f"prefix={a}{b}" for a in "ACGT" for b in "ACGT"}


def test_a_batch_that_is_run_again_counts_once(spark, docs, tmp_path):
    sequences, out, mark = (str(tmp_path / n) for n in ("sequences", "out", "mark"))
    put(spark, docs[:20], sequences)
    pool_spectra.run(spark, sequences, out, mark, K)
    os.remove(f"{mark}/commits/0")  # the batch was written, but its end was never noted
    if os.path.exists(f"{mark}/commits/.0.crc"):
        os.remove(f"{mark}/commits/.0.crc")
    pool_spectra.run(spark, sequences, out, mark, K)
    assert result(pool_spectra.read(spark, out)) == plain_spectrum(docs[:20])
    put(spark, docs[20:], sequences)
    pool_spectra.run(spark, sequences, out, mark, K)
    assert result(pool_spectra.read(spark, out)) == plain_spectrum(docs)


def test_spectra_of_nothing(spark, tmp_path):
    sequences, out, mark = (str(tmp_path / n) for n in ("sequences", "out", "mark"))
    os.makedirs(sequences)
    for _ in range(2):
        pool_spectra.run(spark, sequences, out, mark, K)
        assert pool_spectra.read(spark, out).count() == 0
    put(spark, [(1, None, None)], sequences)
    pool_spectra.run(spark, sequences, out, mark, K)
    assert pool_spectra.read(spark, out).count() == 0
    with pytest.raises(ValueError):
        pool_spectra.run(spark, sequences, out, mark, 13)


def plain_atlas(rows, k):
    out = set()
    for doc_id, text, pool in rows:
        s = dna(text)
        words = [(s + s[: k - 1])[i : i + k] for i in range(len(s))] if len(s) >= k else []
        count = Counter(words)
        at = [i for i, w in enumerate(words) if count[w] > 1]
        heads, longest = defaultdict(set), 0
        for i, j in zip(at, at[1:] + at[:1]):
            heads[words[i]].add(words[j])
            longest = max(longest, j - i if j > i else j - i + len(s))
        out.add((doc_id, pool, len(s), len(heads), sum(map(len, heads.values())), len(at), max((count[words[i]] for i in at), default=0), sum(len(h) > 1 for h in heads.values()), longest, k))
    return out


def test_atlas_and_its_reruns(spark, docs, tmp_path):
    sequences, out = str(tmp_path / "sequences"), str(tmp_path / "out")
    put(spark, docs, sequences)
    repeat_atlas.run(spark, sequences, out, [8])
    repeat_atlas.run(spark, sequences, out, [8, 12])
    want = plain_atlas(docs, 8) | plain_atlas(docs, 12)
    assert result(repeat_atlas.read(spark, out)) == want
    repeat_atlas.run(spark, sequences, out, [12])
    assert result(repeat_atlas.read(spark, out)) == want
    totals = defaultdict(lambda: [0, 0, 0, 0, 0, 0])
    for _, pool, letters, vertices, _, occurrences, _, _, longest, k in want:
        t = totals[pool, k]
        t[:] = [t[0] + 1, t[1] + (vertices > 0), t[2] + letters, t[3] + vertices, t[4] + occurrences, max(t[5], longest)]
    assert result(repeat_atlas.read_pools(spark, out)) == {(p, *t, k) for (p, k), t in totals.items()}


def test_command_lines(spark, docs, tmp_path):
    sequences = str(tmp_path / "sequences")
    put(spark, docs[:10], sequences)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"sequences": sequences, "output": str(tmp_path / "wrong"), "checkpoint": str(tmp_path / "mark"), "k": K}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.pool_spectra", "--config", str(config), "--output", str(tmp_path / "out")], cwd=Path(__file__).parents[1], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "read 10 new rows in 1 batches" in done.stderr and "wrote" in done.stderr
    assert result(pool_spectra.read(spark, str(tmp_path / "out"))) == plain_spectrum(docs[:10])
    config.write_text('{"sequence": "x"}')
    done = subprocess.run([sys.executable, "-m", "jobs.repeat_atlas", "--config", str(config)], cwd=Path(__file__).parents[1], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 2 and "unknown settings: sequence" in done.stderr
