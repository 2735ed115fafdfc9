"""Vocabulary lookups for many names or ids at once.

A lookup takes a ``seeds`` DataFrame ``(query_id, name)``, or ``(query_id,
concept_id)`` for the id-keyed core, and answers all of its rows in one plan of
equi-joins. Join strategies are left to Catalyst and adaptive execution, which
broadcast a side only when its size is known to be small and split hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.sources.vocabulary import CONCEPT_COLUMNS, Vocabulary


def in_vocabularies(df: DataFrame, vocabulary_ids: Sequence[str] | None) -> DataFrame:
    """Keep the given vocabularies; ``None`` or an empty list keeps all."""
    if not vocabulary_ids:
        return df
    return df.filter(F.col("vocabulary_id").isin(list(vocabulary_ids)))


def ids_matching_name(
    seeds: DataFrame, vocab: Vocabulary, vocabulary_ids: Sequence[str] | None = None
) -> DataFrame:
    """``(query_id, concept_id)`` of the concepts bearing each seed's name."""
    concept = in_vocabularies(vocab.concept, vocabulary_ids).select(
        F.lower("concept_name").alias("name_key"), "concept_id"
    )
    keyed = seeds.select("query_id", F.lower("name").alias("name_key"))
    return keyed.join(concept, "name_key").select("query_id", "concept_id")


def separation_within(minimum: int = 0, maximum: int | None = None) -> Column:
    """Bounds on the levels of separation, alike in both directions."""
    bound = F.col("min_levels_of_separation") >= minimum
    if maximum is not None:
        bound = bound & (F.col("max_levels_of_separation") <= maximum)
    return bound


def ancestor_edges(
    vocab: Vocabulary, minimum: int = 0, maximum: int | None = None
) -> DataFrame:
    """``(seed_id, target_id)`` from a concept to its ancestors."""
    return vocab.concept_ancestor.filter(separation_within(minimum, maximum)).select(
        F.col("descendant_concept_id").alias("seed_id"),
        F.col("ancestor_concept_id").alias("target_id"),
    )


def descendant_edges(
    vocab: Vocabulary, minimum: int = 0, maximum: int | None = None
) -> DataFrame:
    """``(seed_id, target_id)`` from a concept to its descendants."""
    return vocab.concept_ancestor.filter(separation_within(minimum, maximum)).select(
        F.col("ancestor_concept_id").alias("seed_id"),
        F.col("descendant_concept_id").alias("target_id"),
    )


def related_edges(vocab: Vocabulary) -> DataFrame:
    """``(seed_id, target_id)`` of every relationship, whatever its kind."""
    return vocab.concept_relationship.select(
        F.col("concept_id_1").alias("seed_id"), F.col("concept_id_2").alias("target_id")
    )


def concepts_along(ids: DataFrame, edges: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Concept rows reached from ``(query_id, concept_id)``; duplicates are kept."""
    reached = ids.join(edges, F.col("concept_id") == F.col("seed_id")).select(
        "query_id", F.col("target_id").alias("concept_id")
    )
    return reached.join(vocab.concept, "concept_id").select("query_id", *CONCEPT_COLUMNS)


def ancestors_by_id(
    ids: DataFrame, vocab: Vocabulary, minimum: int = 0, maximum: int | None = None
) -> DataFrame:
    return concepts_along(ids, ancestor_edges(vocab, minimum, maximum), vocab)


def descendants_by_id(
    ids: DataFrame, vocab: Vocabulary, minimum: int = 0, maximum: int | None = None
) -> DataFrame:
    return concepts_along(ids, descendant_edges(vocab, minimum, maximum), vocab)


def related_by_id(ids: DataFrame, vocab: Vocabulary) -> DataFrame:
    return concepts_along(ids, related_edges(vocab), vocab)


def ancestors_by_name(
    seeds: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    minimum: int = 0,
    maximum: int | None = None,
) -> DataFrame:
    ids = ids_matching_name(seeds, vocab, vocabulary_ids)
    return ancestors_by_id(ids, vocab, minimum, maximum)


def descendants_by_name(
    seeds: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    minimum: int = 0,
    maximum: int | None = None,
) -> DataFrame:
    ids = ids_matching_name(seeds, vocab, vocabulary_ids)
    return descendants_by_id(ids, vocab, minimum, maximum)


def related_by_name(
    seeds: DataFrame, vocab: Vocabulary, vocabulary_ids: Sequence[str] | None = None
) -> DataFrame:
    """Concepts related to the seeds; ``vocabulary_ids`` restricts the seeds only."""
    return related_by_id(ids_matching_name(seeds, vocab, vocabulary_ids), vocab)


def all_vocabularies(vocab: Vocabulary) -> DataFrame:
    return vocab.concept.select("vocabulary_id").distinct()


def name_pairs(
    edges: DataFrame,
    vocab: Vocabulary,
    wanted: DataFrame,
    vocabulary_ids: Sequence[str] | None = None,
    lower_targets: bool = True,
) -> DataFrame:
    """Distinct ``(seed_key, target_key)`` pairs of names linked by an edge.

    ``wanted`` holds the pairs ``(seed_key, target_key)`` an evaluation asks
    about, as a table that is cheap to read again. Names repeat, so a name-first
    lookup multiplies rows; here every edge looks up its two ends by the unique
    concept id. The concepts whose names are asked about are found in one scan
    and stored; edges between others are dropped, and repeated edges reduced to
    one, before names are joined. The result has no repeats, so a left join to it
    never multiplies the rows of an evaluation set.
    """
    asked = (
        wanted.select(F.explode(F.array(_end(SEED, "seed_key"), _end(TARGET, "target_key"))).alias("end"))
        .select("end.*")
        .where("key is not null")
        .distinct()
    )
    name = F.col("concept_name")
    seed_name = F.lower(name)
    if vocabulary_ids:
        seed_name = F.when(F.col("vocabulary_id").isin(list(vocabulary_ids)), seed_name)
    bearing = vocab.concept.withColumn("seed_key", seed_name).withColumn(
        "target_key", F.lower(name) if lower_targets else name
    )
    bearing = bearing.select(
        "concept_id", F.explode(F.array(_end(SEED, "seed_key"), _end(TARGET, "target_key"))).alias("end")
    ).select("concept_id", "end.*")
    ends = materialise(bearing.join(asked, ["kind", "key"], "left_semi"), "name-ends")

    def of(kind: int, side: str) -> DataFrame:
        chosen = ends.where(F.col("kind") == kind)
        return chosen.select(F.col("concept_id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"))

    seeds, targets = of(SEED, "seed"), of(TARGET, "target")
    linked = (
        edges.join(seeds.select("seed_id"), "seed_id", "left_semi")
        .join(targets.select("target_id"), "target_id", "left_semi")
        .distinct()
    )
    return (
        linked.join(seeds, "seed_id").join(targets, "target_id").select("seed_key", "target_key").distinct()
    )


# The kinds of ends of an edge.
SEED, TARGET = 0, 1


def _end(kind: int, key: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"))
