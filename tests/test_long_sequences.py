"""Long sequences: chunks of any cut, blocks, minimizers and borders give what the whole sequence gives."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions.sequences import pseudo_dna, pseudo_dna_of
from strandweave.operators import long_sequences as ls, words

TURN = str.maketrans("ACGT", "TGCA")


def sequences():
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(1500))
    return {
        1: base + base[200:500] + base[::-1].translate(TURN)[:300] + "A" * 900 + base[100:180],
        2: "ACGT" * 150,
        3: "".join(rng.choice("AC") for _ in range(333)),
        4: "ACG",
        5: "",
        6: "A" * 40,
        7: base[:40],
    }


def plain(seqs, k, strands=1):
    out = set()
    for seq_id, s in seqs.items():
        both = [s, s[::-1].translate(TURN)][:strands]
        listed = [[(t + t)[i : i + k] for i in range(len(t))] if len(t) >= k else [] for t in both]
        count = Counter(w for ws in listed for w in ws)
        for strand, ws in enumerate(listed):
            at = [i for i, w in enumerate(ws) if count[w] > 1]
            out |= {(seq_id, strand, i, ws[i], ws[j], (j - i) if j > i else j - i + len(s)) for i, j in zip(at, at[1:] + at[:1])}
    return out


def chunks(spark, seqs, seed):
    rng, rows = random.Random(seed), []
    for seq_id, s in seqs.items():
        at = 0
        while at < len(s):
            n = rng.choice([1, 2, 7, 100, 1000])
            rows.append((seq_id, 0, len(s), at, s[at : at + n]))
            at += n
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ls.CHUNK).repartition(3)


@pytest.mark.parametrize("k,m,block,stretch,strands", [(12, 5, 97, 50, 1), (12, 12, 1 << 16, 1 << 20, 2), (33, 11, 64, 200, 2), (70, 8, 101, 1 << 20, 1), (1, 1, 50, 60, 1), (4, 3, 3, 1000, 2)])
def test_arcs_of_any_cut(spark, monkeypatch, k, m, block, stretch, strands):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "STRETCH", stretch)
    seqs = sequences()
    cut = chunks(spark, seqs, k)
    got = [tuple(r) for r in ls.compacted_arcs(ls.both_strands(cut) if strands == 2 else cut, k, m).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(seqs, k, strands)


def test_a_whole_sequence_and_its_pieces_agree_with_rows(spark):
    seqs = spark.createDataFrame([(i, s) for i, s in sequences().items()], "seq_id long, seq string")
    want = {tuple(r) for r in words.compacted_arcs(seqs, 14).collect()}
    arcs = ls.compacted_arcs(ls.chunked(seqs, 111), 14).drop("strand")
    assert {tuple(r) for r in arcs.collect()} == want
    # the same letters as parts in an order, placed by shards
    parts = [(i, j, s[j * 60 : j * 60 + 60]) for i, s in sequences().items() for j in range(-(-len(s) // 60) + 1)]
    df = spark.createDataFrame(parts, "seq_id long, at long, seq string").repartition(4)
    assert {tuple(r) for r in ls.compacted_arcs(ls.joined(df, "at", F.expr("at div 3")), 14).drop("strand").collect()} == want


def test_what_a_task_holds_does_not_grow_with_copies():
    k, m = 31, 11
    rng = np.random.default_rng(3)
    unit = "".join(rng.choice(list("ACGT"), 3000))
    held = {}
    for copies in (2, 40):
        rows = []
        for c in range(copies):
            block = pa.RecordBatch.from_pydict({"seq_id": [1], "strand": pa.array([0], pa.int32()), "block": [c], "seq": [unit]})
            rows += list(ls.super_words(k, m, 10_000)([block]))
        table = pa.Table.from_batches(rows).sort_by([("seq_id", "ascending"), ("minimizer", "ascending")])
        seen, most, given = ls._Seen(k), 0, 0
        for batch in table.to_batches(max_chunksize=5):
            given += seen.add(batch).num_rows
            most = max(most, len(seen.held[0]))
        held[copies] = most
        assert given == copies * (len(unit) - k + 1)
    assert held[2] == held[40] < 60


def test_other_letters_are_refused(spark):
    bad = spark.createDataFrame([(1, 0, 40, 0, "ACGTN" * 8)], ls.CHUNK)
    with pytest.raises(Exception, match="outside ACGT"):
        ls.repeated_words(bad, 5).collect()


def test_occurrences_are_found_once(spark):
    """what is found is not made again for the first occurrences of the stretches."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, 0, p, f"w{p}") for p in (0, 3, 55, 120, 990)]
    found = spark.createDataFrame(rows, "seq_id long, strand int, pos long, kmer string").repartition(3)
    sizes = spark.createDataFrame([(1, 1000)], "seq_id long, n long")
    got = ls.next_on_circle(found.mapInArrow(through, found.schema), sizes, 50).collect()
    assert seen.value == len(rows)
    assert {(r["pos"], r["head"], r["span"]) for r in got} == {(0, "w3", 3), (3, "w55", 52), (55, "w120", 65), (120, "w990", 870), (990, "w0", 10)}


def test_letters_of_texts_are_the_same_in_python(spark):
    texts = ["The quick brown Fox, JUMPS over\nthe lazy dog", "", None, "Ünïcode ſ K \U0001f600 zZ", "123 \0 []^_`{@"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pseudo_dna("t").alias("s"))
    assert all(r["s"] == pseudo_dna_of(r["t"]) for r in df.collect())
