"""Exact nearest concepts by cosine distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.functions.similarity import cosine_with_norms, norm
from termeval.operators.vector_blocks import (
    RANK_DECIMALS,
    best_per_query,
    candidate_schema,
    list_matrix,
    merge_top,
    top_pairs,
    unit_rows,
)
from termeval.operators.vector_grid import nearest_by_blocks
from termeval.sources.vocabulary import Vocabulary

# Query sets of up to this many vectors and bytes are sent whole to every task.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 * 1024 * 1024

# Ids of vectors without a concept that are broadcast at most.
BROADCAST_IDS = 1_000_000


def nearest_concepts(query_vector: Sequence[float], vocab: Vocabulary, n: int = 5) -> DataFrame:
    """``(concept_id, content, score)`` of the ``n`` nearest concepts, nearest first.

    Vectors are reduced to their distance before they meet the ids of concepts,
    and names are joined to the ``n`` winners.
    """
    query = F.array(*(F.lit(float(x)) for x in query_vector))
    length = F.lit(float(np.linalg.norm(np.asarray(query_vector, dtype=float))))
    vector = F.col("embedding")
    similarity = cosine_with_norms(vector, query, norm(vector), length)
    scored = vocab.concept_embedding.filter(vector.isNotNull()).select(
        "concept_id", (F.lit(1.0) - similarity).alias("score")
    )
    order = F.round("score", RANK_DECIMALS), "concept_id"
    known = scored.join(vocab.concept.select("concept_id"), "concept_id", "left_semi")
    best = known.orderBy(*order).limit(n)
    names = vocab.concept.select("concept_id", F.col("concept_name").alias("content"))
    return best.join(names, "concept_id").select("concept_id", "content", "score").orderBy(*order)


def nearest_concepts_batch(queries: DataFrame, vocab: Vocabulary, n: int = 5) -> DataFrame:
    """``(query_id, rank, concept_id, content, score)`` of each query's ``n`` nearest.

    ``queries`` holds unique ``query_id`` and a ``vector``. Vectors are compared
    in matrix blocks and only the best ``n`` of a task leave it; names are joined
    to the winners. Vectors without a concept are left out: only ids are
    shuffled to find them, unless there are over ``BROADCAST_IDS`` of them.
    """
    vectors = vocab.concept_embedding.filter(F.col("embedding").isNotNull())
    lost = vectors.select("concept_id").join(vocab.concept.select("concept_id"), "concept_id", "left_anti")
    n_lost = lost.limit(BROADCAST_IDS + 1).count()
    if n_lost:
        vectors = vectors.join(F.broadcast(lost) if n_lost <= BROADCAST_IDS else lost, "concept_id", "left_anti")
    queries = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    ranked = nearest_vectors(queries, vectors, n)
    names = vocab.concept.select("concept_id", F.col("concept_name").alias("content"))
    return ranked.join(names, "concept_id").select(
        "query_id", "rank", "concept_id", "content", "score"
    )


def nearest_vectors(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """``(query_id, rank, concept_id, score)`` of each query's ``n`` nearest vectors.

    A query set of checked small size is sent to every task, and the vectors are
    scanned once without a shuffle of their own. A larger one meets the vectors
    block by block. Both compare all pairs by the same function. A vector with a
    NULL, NaN or infinite element, or of length 0, has distance NaN to all, and
    all have distance NaN to it; such pairs rank last, by id.
    """
    rows = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    if rows.num_rows > BROADCAST_QUERIES or rows.nbytes > BROADCAST_BYTES:
        return nearest_by_blocks(queries, vectors, n)
    candidates = _scan(queries.sparkSession, rows, vectors, n, queries.schema["query_id"])
    return best_per_query(candidates, n)


def _scan(spark, rows, vectors, n, id_field) -> DataFrame:
    ids = rows.column("query_id").combine_chunks()
    shared = spark.sparkContext.broadcast((ids, unit_rows(list_matrix(rows.column("vector")))))

    def best_of_task(batches):
        query_ids, query_units = shared.value
        best = None
        for batch in batches:
            concept_ids = batch.column("concept_id").to_numpy()
            units = unit_rows(list_matrix(batch.column("embedding")))
            found = top_pairs(query_units, units, concept_ids, n)
            best = found if best is None else merge_top(best, found, n)
        if best is not None:
            query, distance, concept = best
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(query)), pa.array(concept), pa.array(distance)],
                names=["query_id", "concept_id", "score"],
            )

    return vectors.select("concept_id", "embedding").mapInArrow(
        best_of_task, candidate_schema(id_field.dataType)
    )
