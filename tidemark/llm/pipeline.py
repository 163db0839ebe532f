"""Corpus preparation: quality filter, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes every row that the one before has kept. Null and empty texts pass all filters but the first, which
scores them like others; repeated rows count as copies; an empty table gives an empty result; extra columns pass
through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, ngram_join, quality, secrets, tokens
from .common import Scratch, read, unused

#: Near duplicates have this share of their word n-grams in common.
WORDS, SHARE = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for the label quality = 1 is 0.5 or more; null and empty ones are scored like others, equal rows alike."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    score = unused("_score", docs)
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id; rows without words stay. Ids may repeat or be null."""
    return ngram_join.one_of_each(docs, WORDS, SHARE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty ones stay, repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted again; null texts stay null."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; null and empty ones have one id, repeated rows are all placed."""
    return tokens.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL can't express the trained classifier, the decoded layers and the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is a table in the shared folder, and goes once the next one is written. The last one stays."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as kept:
        for _, stage in STAGES:
            # what a stage leaves behind goes once its rows are written
            with Scratch(spark) as own, own.owning():
                made = kept.saved(stage(spark, docs, sf_dir))
            kept.drop(docs)
            docs = made
        return kept.released(docs)
