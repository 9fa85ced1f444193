"""A corpus pipeline of the operators in moodweave.llm: each stage takes what the one before kept.

run() applies the stages to `documents`; its rows are the pieces of the packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodweave.llm import mixing, neardup, packing, secrets, toxicity
from moodweave.llm.store import discard, settle, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that models learned from `labels` find toxic.

    A null or empty text has no word and gets the score of no evidence, a document with a null key is judged by its text, repeated rows
    are judged alike, very long texts whole; without labels of both classes, or documents, nothing goes; other columns stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (name,) = unused(docs, "toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Null and empty texts are copies of one another, rows with a null key stay, of rows that share key and text one stays, and of a
    class the document of the least key (of one key: of the least hash); very long texts are compared whole; other columns stay.
    """
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark; null texts, null keys, repeated rows, empty tables and other columns stay, and
    very long texts are redacted whole."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come to their target weights.

    A null source is a source; null and empty texts have no word to take and go; null keys draw alike, as do repeated rows, which are
    taken alike; long texts are taken whole but for the one at a source's cut; other columns stay.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows.

    A null or empty text is its closing id alone, repeated rows and null keys are documents of their own, very long texts run over as
    many windows as they need, and an empty table has no piece.  Other columns are not kept: the result is of pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the models, the samples or the tokenizer; tests/llm holds each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # what a stage left is not read again; the input was never settled
    return STAGES[-1][1](spark, docs, sf_dir)
