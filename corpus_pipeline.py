"""From raw documents to packed sequences: five stages, each an operator of strandweave.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents`` for the documents they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import language, mixing, near_duplicates, packing, quality
from strandweave.session import Scratch

#: A document whose language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, trained on this stage's input, scores below its threshold.

    Null and empty texts are scored like any other, long ones whole.  A row is
    judged by its text alone, so rows with a null, tied or repeated doc_id, and
    repeated rows, each get the score of their own text.  An empty table gives
    no rows.
    """
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "_quality")
    return quality.append_scores(docs, forest, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty texts) and those whose language is not recognised.

    Long texts are read whole; tied languages go to the first in order; rows
    with a null lang or doc_id and repeated rows are judged like any other.  An
    empty table, or one without a labelled text, gives no rows.
    """
    named = _free(docs, "_language")
    marked = language.append_languages(docs, language.train(docs), named)
    known = (F.col(f"{named}.lang") != language.UNKNOWN) & (F.col(f"{named}.score") >= LEAST_LANGUAGE_SCORE)
    return marked.where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (five-word shingles, similarity 0.8).

    The row of the class's smallest doc_id stays (null where it has no other);
    of several texts or repeated rows under that id, one.  Documents without a
    word are no copies of anything and all stay.  Texts of any length are
    compared whole.  An empty table gives no rows.
    """
    return near_duplicates.distinct_documents(docs, 5, (4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target marginals of source, language and topic.

    Null source and lang are values of their own; null and empty texts weigh
    nothing and stay; long texts are counted whole; rows that repeat a doc_id
    (null among them) share their draw.  An empty table gives no rows.
    """
    column = _free(docs, "_mix")
    return mixing.mix(docs, column=column).where(f"{column}.kept").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: one row per piece.

    A null or empty text is its end token alone; long texts span sequences;
    every row is packed, repeated rows and doc_ids (null among them) too.  An
    empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", judge_quality),
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and MinHash are not expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
