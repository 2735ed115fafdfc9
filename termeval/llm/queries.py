"""The registered queries of the text operators: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termeval.llm import (
    bpe,
    decontaminate,
    language,
    lexical_search,
    licence_digest,
    merkle,
    repeats,
    shingle_join,
    spelling,
    substring_dedup,
    surrogates,
    toxicity,
    url_trust,
)
from termeval.llm.licence_texts import LICENCES
from termeval.llm.shared import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register ``build`` under its own name."""
    QUERIES[build.__name__] = build
    return build


@query
def op1_merkle(spark, folder):
    return merkle.edits(table(spark, folder, "documents"))


# A secret of whoever runs the query; the same key gives the same surrogates.
KEY = "change me"


@query
def op2_surrogates(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace(documents, KEY)


@query
def op3_toxicity(spark, folder):
    documents, kept = table(spark, folder, "documents"), held_out(F.col("doc_id"))
    known = toxicity.labelled(documents.where(~kept), table(spark, folder, "labels"))
    return toxicity.score(documents, toxicity.train(known), (F.col("doc_id"), kept.alias("held_out")))


# The rules of this query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op4_url_trust(spark, folder):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_trust.judge(table(spark, folder, "pages"), rules)


@query
def op5_licence_digest(spark, folder):
    known = spark.createDataFrame(list(LICENCES.items()), "name string, text string")
    found = licence_digest.scan(table(spark, folder, "documents"), known)
    return found.withColumn("notices", F.array_join("notices", ";"))


@query
def op6_decontaminate(spark, folder):
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_shingle_join(spark, folder):
    return shingle_join.join(table(spark, folder, "documents"))


@query
def op8_repeats(spark, folder):
    return repeats.passages(table(spark, folder, "documents"))


@query
def op9_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_language(spark, folder):
    documents = table(spark, folder, "documents")
    training = documents.where(~held_out(F.col("doc_id")))
    kept = held_out(F.col("doc_id")).alias("held_out")
    return language.predict(documents, language.profiles(training), keep=(kept,))


@query
def op11_substring_dedup(spark, folder):
    kept = substring_dedup.remove(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_lexical_search(spark, folder):
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_spelling(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))
