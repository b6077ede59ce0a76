"""The byte-range source gives the same records for every cut of a file."""

import random

import pytest

from strandweave.operators import long_sequences
from strandweave.sources import fasta_ranges as fr
from strandweave.sources import sequences as src

TEXT = b"; no record\n>one first record\nACGT\nacg t\n\n>two\r\nGG\r\nCC\r\n>empty\n>three a>b\nA>CG\nT\n>last\nTTTT"
ROWS = [("one", "first record", "ACGTACGT"), ("two", "", "GGCC"), ("empty", "", ""), ("three", "a>b", "A>CGT"), ("last", "", "TTTT")]


def rows(path, size, chunk=1 << 16):
    reader = fr.FastaReader({"path": str(path), "range": str(size), "chunk": str(chunk)})
    return [r for p in reader.partitions() for r in reader.read(p)]


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_every_cut_gives_the_same_records(tmp_path, monkeypatch, block):
    monkeypatch.setattr(fr, "BLOCK", block)
    path = tmp_path / "a.fasta"
    path.write_bytes(TEXT)
    offsets = [TEXT.index(b">" + name.encode()) for name, _, _ in ROWS]
    for size in range(1, len(TEXT) + 2):
        got = rows(path, size)
        assert [(r[1], r[2], r[3], r[5]) for r in got] == [(o, *r) for o, r in zip(offsets, ROWS)], size
        parts = rows(path, size, chunk=3)
        assert all(len(r[5]) <= 3 for r in parts)
        whole = {}
        for r in parts:
            assert len(whole.setdefault(r[1], "")) == r[4]
            whole[r[1]] += r[5]
        assert whole == {o: r[2] for o, r in zip(offsets, ROWS)}


def test_a_record_over_many_ranges_and_folders(spark, tmp_path):
    rng = random.Random(2)
    long = "".join(rng.choice("ACGT") for _ in range(5000))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "x.fa").write_text(f">long\n{long}\n>short\nAC\n")
    (tmp_path / "in" / "deep" / "y.fa").write_text(">other\nACGT\n")
    (tmp_path / "in" / "_hidden.fa").write_text(">no\nA\n")
    (tmp_path / "in" / "deep" / "empty.fa").write_text("")
    got = {}
    for size in (100, 1700, 1 << 20):
        df = fr.whole_records(fr.read(spark, str(tmp_path / "in"), size, chunk=64))
        got[size] = sorted((r["file"].removeprefix(str(tmp_path)), r["offset"], r["name"], r["seq"]) for r in df.collect())
    assert got[100] == got[1700] == got[1 << 20] == [("/in/deep/y.fa", 0, "other", "ACGT"), ("/in/x.fa", 0, "long", long), ("/in/x.fa", 5007, "short", "AC")]
    arcs = long_sequences.compacted_arcs(fr.chunks(fr.read(spark, f"file:{tmp_path}/in/x.fa", 700, chunk=50)), 5)
    want = long_sequences.compacted_arcs(long_sequences.chunked(spark.createDataFrame([(1, long)], "seq_id long, seq string")), 5)
    one = lambda df: sorted(tuple(r) for r in df.select("pos", "tail", "head", "span").collect())
    assert one(arcs) == one(want)
    with pytest.raises(Exception, match="nowhere"):
        fr.read(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "none").mkdir()
    assert fr.read(spark, str(tmp_path / "none")).count() == 0


def test_what_is_written_comes_back(spark, tmp_path):
    data = [(f"n{i} d {i}", "ACGT" * (i % 50)) for i in range(120)]
    src.write_fasta(spark.createDataFrame(data, "name string, seq string").repartition(3), str(tmp_path / "out"))
    found = fr.whole_records(fr.read(spark, str(tmp_path / "out"), 333)).collect()
    assert sorted((f"{r['name']} {r['description']}", r["seq"]) for r in found) == sorted(data)
