"""Sessions over streams in several orders, late rows, restarts; table functions in SQL."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from strandweave.functions import tables
from strandweave.streaming import sessions

BEGIN = datetime(2024, 3, 1)


def rows():
    rng = random.Random(7)
    return [(rng.randrange(4), BEGIN + timedelta(minutes=rng.randrange(60 * 24 * 6))) for _ in range(300)]


def plain(events, gap=timedelta(hours=2)):
    out = set()
    for user in {u for u, _ in events}:
        times = sorted(t for u, t in events if u == user)
        stretch = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t - stretch[-1] > gap:
                out.add((user, stretch[0], stretch[-1], len(stretch)))
                stretch = []
            stretch.append(t)
    return out


def put(spark, events, path):
    spark.createDataFrame(events, "user_id long, at timestamp").coalesce(1).write.mode("append").parquet(path)


def close(spark, events, path, late):
    df = spark.createDataFrame(events, "user_id long, at timestamp")
    sessions.closing(df, "user_id", "at", "2 hours", late).write.mode("append").parquet(path)


def read(spark, out):
    got = [tuple(r) for r in spark.read.schema("user_id long, start timestamp, last timestamp, n long").parquet(out).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("backwards,late", [(False, "1 hour"), (True, "30 days")])
def test_a_replay_gives_the_sessions_of_the_batch(spark, tmp_path, backwards, late):
    events, (path, out, state) = rows(), (str(tmp_path / n) for n in ("events", "out", "state"))
    batch = sessions.sessions(spark.createDataFrame(events, "user_id long, at timestamp"), "user_id", "at", "2 hours")
    assert {tuple(r) for r in batch.collect()} == plain(events)
    lots = [[e for e in events if (e[1] - BEGIN).days // 2 == n] for n in range(3)]
    total = Counter()
    for lot in reversed(lots) if backwards else lots:  # a stop after each lot
        put(spark, lot, path)
        total += Counter(sessions.run(spark, path, out, state, "user_id", "at", "2 hours", late))
    assert len(read(spark, out)) < len(plain(events))  # what is still open waits
    close(spark, events, path, late)
    total += Counter(sessions.run(spark, path, out, state, "user_id", "at", "2 hours", late))
    assert read(spark, out) == plain(events) and total["rows"] == len(events) + 1 and total["late"] == 0
    before = read(spark, out)
    assert sessions.run(spark, path, out, state, "user_id", "at", "2 hours", late)["rows"] == 0 and read(spark, out) == before


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    events, (path, out, state) = rows(), (str(tmp_path / n) for n in ("events", "out", "state"))
    early = [e for e in events if e[1] < BEGIN + timedelta(days=3)]
    rest = [e for e in events if e[1] >= BEGIN + timedelta(days=3)]
    put(spark, rest, path)
    sessions.run(spark, path, out, state, "user_id", "at", "2 hours", "1 hour")
    put(spark, early, path)
    close(spark, events, path, "1 hour")
    seen = sessions.run(spark, path, out, state, "user_id", "at", "2 hours", "1 hour")
    assert seen["late"] == len(early) and read(spark, out) == plain(rest)


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "abab"), (2, None), (3, "a"), (4, "")], "id int, text string").createOrReplaceTempView("texts_of_a_test")
    got = {tuple(r) for r in spark.sql("SELECT t.id, w.* FROM texts_of_a_test t, LATERAL sw_words(t.text, 2) w").collect()}
    assert got == {(1, "ab", 2), (1, "ba", 1)}
    steps = [(g, i, s) for g, word in enumerate(["ABAC", "X", "AAA"]) for i, s in enumerate(word)]
    spark.createDataFrame(steps, "graph_id long, at int, symbol string").repartition(3).createOrReplaceTempView("steps_of_a_test")
    arcs = spark.sql("SELECT * FROM sw_walk(TABLE(steps_of_a_test) PARTITION BY graph_id ORDER BY at)").collect()
    want = Counter()
    for g, word in enumerate(["ABAC", "X", "AAA"]):
        want.update((g, u, v) for u, v in zip(word, word[1:] + word[0]))
    assert sorted(tuple(r) for r in arcs) == sorted((*k, m) for k, m in want.items())
    for name in ("texts_of_a_test", "steps_of_a_test"):
        spark.catalog.dropTempView(name)


def test_words_of_many_texts_are_counted_together(spark, monkeypatch):
    """a task gives a word once for each lot of texts, not once for each text."""
    tables.register(spark)
    texts = ["abab", None, "a", "", "ba\0ü", "\U0001f600ab", "übab\n"]
    spark.createDataFrame([(t,) for t in texts * 500], "text string").coalesce(1).createOrReplaceTempView("many_texts_of_a_test")
    for k in (1, 2, 4, 40):
        want = Counter(t[i : i + k] for t in texts for t in [t or ""] for i in range(len(t) - k + 1))
        got = spark.sql(f"SELECT * FROM sw_word_counts(TABLE(SELECT text FROM many_texts_of_a_test), {k})").collect()
        assert sorted(map(tuple, got)) == sorted((w, 500 * n) for w, n in want.items())
    spark.catalog.dropTempView("many_texts_of_a_test")
    long = ["".join(chr(0x400 + i * i % 1500) for i in range(200)), "xyz" * 30]  # too many letters for one number
    monkeypatch.setattr(tables, "LOT", 100)
    for k in (5, 7):
        made, got = tables.WordCounts(), Counter()
        table = pa.RecordBatch.from_arrays([pa.array(long * 3)], names=["text"])
        for part in [*made.eval(table, pa.array([k] * 6)), *made.terminate()]:
            got.update(dict(zip(*(c.to_pylist() for c in part.columns))))
        assert got == Counter(t[i : i + k] for t in long * 3 for i in range(len(t) - k + 1))
