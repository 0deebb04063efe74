"""The corpus pipeline: language ID, quality rules, near duplicates, mixing, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; what it decides takes effect on them.  All but the last return the
columns of documents.

Columns beyond those of documents go through as they are, whatever they are
called: they are packed while a stage works.  Rows are told apart by nothing
but their values, so rows that repeat share their fate except where a stage
says otherwise.  An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule.llm import jaccard, langid, mixing, pieces, quality
from noctule.llm import text as T
from noctule.llm.queries import PIECES, query
from noctule.llm.tables import bounded_batches, settled


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def set_aside(stage: Stage) -> Stage:
    """The stage on the columns of documents; others are packed into one and come back after it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = T.only(docs.withColumn("_set_aside", F.struct(*(F.col(f"`{c}`") for c in others))), *(c for c in COLUMNS if c in docs.columns), "_set_aside")
        out = stage(spark, packed, sf_dir)
        return out.select(*(F.col("_set_aside")[c].alias(c) if c in others else F.col(c) for c in docs.columns))

    return run


@set_aside
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found that wrote a fair share; the model comes from those with a lang.

    Null and empty texts, and those without a letter, go; so does every document
    where none has a lang to learn from.  A null lang is not learned from.  Of
    languages with equal shares the first in order is taken.  Long texts are
    read whole.
    """
    bounded_batches(spark)
    found = langid.predict(docs, langid.learn(docs, "text", "lang"))
    return T.only(found.where(langid.accepted()), *docs.columns)


@set_aside
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts have no word and go.  Each rule is a comparison with a
    threshold, which a value equal to it passes.  Long texts are read whole.
    """
    return T.only(quality.judge(docs).where("kept"), *docs.columns)


@set_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: of the least doc_id, one where rows repeat it.

    Null, empty and blank texts are nobody's copies and stay.  A null doc_id
    comes behind all others.  Long texts are compared whole.
    """
    bounded_batches(spark)
    return jaccard.one_of_each(docs)


@set_aside
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, or one to three times.

    Documents without a word are taken not at all.  A null source is a source.
    Rows equal in doc_id and text are taken together.
    """
    mixed = mixing.mix(docs, "source", T.n_words(F.col("text")), mixing.identity(F.col("doc_id"), F.col("text")), mixing.word_share(F.col("text")))
    repeats = F.when(F.col("taken") > 0, F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).otherwise(F.array().cast("array<int>"))
    return T.only(mixed.withColumn("_repeat", F.explode(repeats)), *docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and SentencePiece ids of every row, and whether they decode to its text.

    A null text has null ids, an empty one none.  Long texts are encoded whole, block by block.
    """
    bounded_batches(spark)
    coded = pieces.add_ids(T.only(docs, "doc_id", "source", "text"), pieces.load(PIECES))
    return coded.select("doc_id", "source", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]
#: Mixtures of languages, chosen paths and Viterbi have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settled(docs, f"stage-{number}")
    return docs


query("pipeline", ORACLE_SQL)(run)
