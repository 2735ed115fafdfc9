"""A pipeline from raw documents to token ids, in five stages of the text operators.

Each stage takes (spark, docs, folder) and returns the documents it keeps, with
their columns; the last returns tokens. Stages are written and read again, so
each starts from durable rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm import bpe, decontaminate, shingle_join, surrogates, toxicity
from termeval.llm.queries import KEY
from termeval.llm.shared import held_out, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the models of toxic and ordinary text, trained on the labels, do not reject.

    Each row is judged by its own text; null and empty texts get the score of no
    letters. Repeated rows and rows without an id are judged like any other.
    """
    known = toxicity.labelled(docs.where(~held_out(F.col("doc_id"))), table(spark, folder, "labels"))
    scored = toxicity.score(docs, toxicity.train(known), tuple(F.col(c) for c in docs.columns))
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the least id of each group of near copies: texts that share 80 % of all five-word shingles of both.

    Rows that share an id are one document: they stay, or go if one of their
    texts is a near copy of a document with a lesser id. A row without an id
    stays, and takes no other's place. Null and empty texts are no copies.
    """
    joined = shingle_join.join(docs, words=5, percent=80)
    return without(docs, joined.where("component_id < doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, nor 64 letters of a longer one from a place on that is searched for.

    Rows that share an id go together; a row without an id stays.
    """
    return without(docs, decontaminate.matches(docs, table(spark, folder, "benchmark")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced and ``n_chars`` counted anew."""
    replaced = surrogates.replace(docs, KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", replace_personal_data),
    ("bpe", encode),
]

# SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
