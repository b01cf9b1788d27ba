"""Corpus pipeline: language ID, near-duplicate removal, mixing to target weights, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.language_id import language_predictions
from wayfold.llm.minhash import without_near_duplicates
from wayfold.llm.mixing import mix, word_count
from wayfold.llm.names import unused
from wayfold.llm.packing import packed_documents
from wayfold.llm.scratch import stored

#: A document is rejected if it has no letter, or if its language knows less than this share of its n-grams.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, with their columns as they are.

    Null, empty and letterless texts go, as does everything where no row is labelled; texts are read whole, whatever
    their length.  Repeated rows and null ids are judged row by row, ties of languages go to the smaller name.  An empty
    table stays empty.  Columns of the names used inside do not matter.
    """
    lang, score = unused(docs.columns, "__lang", "__score")
    found = language_predictions(docs, keep=tuple(c for c in docs.columns if c != "doc_id"), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Null, empty and wordless texts are near to nothing and stay, as do rows with a null id; of rows that repeat an id one
    stays.  Very long texts are compared whole.  An empty table stays empty.  Other columns pass through.
    """
    return without_near_duplicates(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, at most twice.

    Null, empty and wordless texts have no size and are never taken; null sources are one source.  Rows equal in id, size
    and source are taken alike; a document longer than its source's target may be left out.  An empty table stays empty.
    """
    times, copy = unused(docs.columns, "__mix_times", "__mix_copy")
    taken = mix(docs, word_count("text"), prefix=times.removesuffix("times")).where(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(copy)).drop(copy)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix, placed in sequences.

    A null or empty text is its end alone; texts longer than a sequence are cut into pieces.  Repeated rows and null ids
    are packed each on their own.  An empty table gives an empty result.  Other columns than id and text end here.
    """
    return packed_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: No SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
