"""The pipeline: every stage against a plain version of its decision, on documents with odd rows mixed in."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from strandweave.llm import language, mixing, quality  # noqa: E402

from test_documents import brute_classes, check_packing, odd_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None if d is None else d + 10**6, t, lang, source, n) for d, t, lang, source, n, *_ in odd_rows()]
    rows = base.unionByName(spark.createDataFrame(odd, base.schema))
    return rows.withColumn("_quality", F.lit("clash")).withColumn("_mix", F.lit(1)).withColumn("_Cell", F.lit(2)).withColumn("_probability", F.lit("p")).withColumn("_kept", F.lit(3)).repartition(4)


def ids(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_quality_stage(spark, docs):
    out = cp.judge_quality(spark, docs, SF)
    assert out.columns == docs.columns
    forest = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.append_scores(docs.select("doc_id", "text"), forest, "s").collect()
    assert ids(out) == Counter((r["doc_id"], r["text"]) for r in scores if r["s"] >= 0.3)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    kept = {d for d, _ in ids(out)}
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_language_stage(spark, docs):
    out = cp.identify_language(spark, docs, SF)
    assert out.columns == docs.columns
    model = language.train(docs)
    rows = docs.select("doc_id", "text").collect()
    langs, scores = language.predict(model, [r["text"] for r in rows])
    assert ids(out) == Counter((r["doc_id"], r["text"]) for r, lang, s in zip(rows, langs, scores) if lang != "und" and s >= cp.LEAST_LANGUAGE_SCORE)


def test_near_duplicate_stage(spark, docs):
    out = cp.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {d for d, _, c in brute_classes(rows, 5, 4, 5) if d == c}
    assert {d for d, _ in ids(out)} == kept
    assert all(n == 1 for n in ids(out).values())


def test_mixing_stage(spark, docs):
    out = cp.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns and not ids(out) - ids(docs)
    expected = mixing.mix(docs, column="m").select(F.sum(F.col("m.tokens") * F.col("m.probability")).alias("e"), F.sum("m.tokens").alias("t")).first()
    assert abs(expected["e"] / expected["t"] - mixing.FRACTION) < 1e-6


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_an_empty_table(spark, docs, name, stage):
    out = stage(spark, spark.createDataFrame([], docs.schema), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_packing_stage_and_run(spark, docs):
    assert check_packing(docs.limit(150), 4096) == 0
    pieces = cp.run(spark, SF)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    assert whole.count() > 50 and whole.where("n <> d").count() == 0
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
