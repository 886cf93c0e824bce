"""A corpus from raw documents: language, near copies, repeated passages, mixture, sequences.

Each stage works on all that the one before it kept, written as Parquet to the shared folder. Columns beside the
text and the id pass through the first four stages whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, mixing, packing, phrases, simhash
from sparkloom.llm.common import carried, materialize, scope, uncarried
from sparkloom.llm.queries import vocabulary

#: Documents whose best profile is farther than this (of 0 to 1, higher is nearer) are no language that was learned: gibberish scores
#: below 0.2, a language that was not learned 0.2 to 0.35, short clean texts of two words 0.45, and no document of the labelled tables below 0.39.
LEAST_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them) and those that are like no learned language.

    Profiles are learned from rows with a language and an id that isn't held out; without any, all go. Repeated rows agree.
    """
    found = langid.identify(carried(docs, text=F.col("text")), langid.learn(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return uncarried(kept, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles) stays: the smallest id.

    Null ids are larger than any; of repeated rows one stays. Texts without words are copies of one another.
    """
    return simhash.keep_one_similar(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages (50 words or more) that a smaller document holds; documents that were nothing else go.

    Null ids are larger than any; rows of one id don't cut one another. Rows without words stay as they are.
    """
    return phrases.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    A null source is a source; rows without words take no words and go as often as their source's whole copies.
    """
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids: of a null or empty text the end id alone; a repeated row is packed again."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can't express the profiles, the fingerprints or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark):  # tables of the stage go with it; what it returns stays for the next
            docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
