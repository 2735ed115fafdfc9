"""Concept lookup for many search terms, with synonyms, ancestors, relations.

Candidates and their linked entries are relational: a search term may find any
number of concepts and a concept may have any number of relations. An answer is
one nested row for each term, bounded in both: the best concepts, and of each
the first entries of every section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.functions.similarity import fuzzy_ratio
from termeval.operators.search import concept_hits
from termeval.operators.vocabulary import ancestor_edges, related_edges
from termeval.sources.vocabulary import Vocabulary


def concept_candidates(
    searches: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    mode: str = "any",
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Matching standard concepts with their name similarity to the search term."""
    found = concept_hits(searches, vocab, vocabulary_ids, mode=mode, dictionary=dictionary)
    return found.select(
        "query_id",
        "search_term",
        "concept_name",
        "concept_id",
        "vocabulary_id",
        "concept_code",
        fuzzy_ratio(F.col("search_term"), F.col("concept_name")).alias(
            "concept_name_similarity_score"
        ),
    )


def concept_links(candidates: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Linked entries of the candidates, one row each.

    ``section`` is CONCEPT_SYNONYM, CONCEPT_ANCESTOR or CONCEPT_RELATIONSHIP;
    ``linked_id`` is NULL for synonyms. Links are restricted to the candidates
    before their names are looked up.
    """
    found = candidates.select("query_id", "concept_id").distinct()
    synonyms = vocab.concept_synonym.join(found, "concept_id").select(
        "query_id",
        "concept_id",
        F.lit("CONCEPT_SYNONYM").alias("section"),
        F.lit(None).cast("bigint").alias("linked_id"),
        F.col("concept_synonym_name").alias("linked_name"),
    )
    edges = ancestor_edges(vocab).withColumn("section", F.lit("CONCEPT_ANCESTOR"))
    edges = edges.unionByName(
        related_edges(vocab).withColumn("section", F.lit("CONCEPT_RELATIONSHIP"))
    )
    names = vocab.concept.select(
        F.col("concept_id").alias("linked_id"), F.col("concept_name").alias("linked_name")
    )
    linked = (
        edges.select(
            F.col("seed_id").alias("concept_id"), F.col("target_id").alias("linked_id"), "section"
        )
        .join(found, "concept_id")
        .join(names, "linked_id")
        .select("query_id", "concept_id", "section", "linked_id", "linked_name")
    )
    return synonyms.unionByName(linked)


SECTIONS = ("CONCEPT_SYNONYM", "CONCEPT_ANCESTOR", "CONCEPT_RELATIONSHIP")
SCORE = "concept_name_similarity_score"


def concept_answers(
    searches: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    mode: str = "any",
    n: int = 10,
    n_links: int = 20,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, search_term, CONCEPT)``: one answer for every search term.

    ``CONCEPT`` lists the ``n`` best matching concepts by similarity (ties by id)
    and is empty for a term that matches none. Each has a list for every section,
    of its first ``n_links`` different entries ``(linked_id, linked_name)`` by name
    and id. Tasks cut terms and sections to their limits before the shuffle.
    """
    found = concept_candidates(searches, vocab, vocabulary_ids, mode, dictionary)
    by_score = Window.partitionBy("query_id").orderBy(F.desc(SCORE), "concept_id")
    best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)
    best = materialise(best, "answers")
    asked = best.select(F.col("concept_id").alias("query_id"), "concept_id").distinct()
    by_name = Window.partitionBy("concept_id", "section").orderBy("linked_name", "linked_id")
    links = concept_links(asked, vocab).drop("query_id").distinct()
    links = links.withColumn("place", F.row_number().over(by_name)).where(F.col("place") <= n_links)

    def entries(section: str):
        listed = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("place", "linked_id", "linked_name"))))
        return F.transform(listed, lambda x: F.struct(x["linked_id"], x["linked_name"])).alias(section)

    linked = links.groupBy("concept_id").agg(*(entries(section) for section in SECTIONS))
    empty = F.array().cast(linked.schema[SECTIONS[0]].dataType)
    columns = ["concept_name", "concept_id", "vocabulary_id", "concept_code", SCORE]
    concepts = best.join(linked, "concept_id", "left").select(
        "query_id",
        F.struct("rank", *columns, *(F.coalesce(section, empty).alias(section) for section in SECTIONS)).alias("found"),
    )
    listed = concepts.groupBy("query_id").agg(F.sort_array(F.collect_list("found")).alias("listed"))
    shown = F.transform("listed", lambda x: F.struct(*(x[c].alias(c) for c in (*columns, *SECTIONS))))
    answers = listed.select("query_id", shown.alias("CONCEPT"))
    none = F.array().cast(answers.schema["CONCEPT"].dataType)
    return (
        searches.select("query_id", "search_term")
        .join(answers, "query_id", "left")
        .select("query_id", "search_term", F.coalesce("CONCEPT", none).alias("CONCEPT"))
    )
