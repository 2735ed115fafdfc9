"""Exact nearest vectors for query sets too large to send to every task.

Queries and vectors are dealt by their ids into bundles of as many blocks as a
task can hold, and every bundle of queries meets every bundle of vectors in a
group of its own, block by block. A query is copied once for each bundle of
vectors and a vector once for each bundle of queries; the work is queries times
vectors, which no exact search avoids where distances are all alike, as in many
dimensions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.operators.vector_blocks import (
    BUNDLE_BYTES,
    TILE_ROWS,
    Units,
    best_per_query,
    bundles,
    candidate_schema,
    top_pairs,
)

# Rows per side of a block, which is also what is made of doubles at once.
BLOCK_ROWS = TILE_ROWS


def nearest_by_blocks(
    queries: DataFrame, vectors: DataFrame, n: int, block_rows: int = BLOCK_ROWS, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """``(query_id, rank, concept_id, score)`` as ``vectors.nearest_vectors``.

    At most ``block_rows`` rows of either side are made of doubles and compared at
    once; a task is dealt up to ``bundle_bytes`` of doubles of either side, which it holds as
    they came, and copies are made for bundles only.
    """
    queries = materialise(queries.select("query_id", "vector"), "queries")
    vectors = materialise(vectors.select("concept_id", "embedding"), "vectors")

    def parts(rows, vector):
        rows, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
        return bundles(rows, width or 0, -(-rows // block_rows), bundle_bytes)

    query_bundles, vector_bundles = parts(queries, "vector"), parts(vectors, "embedding")

    def part(key, parts):
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    asking = queries.select(
        part("query_id", query_bundles).alias("query_bundle"),
        every(vector_bundles).alias("vector_bundle"),
        "query_id",
        "vector",
    )
    answering = vectors.select(
        every(query_bundles).alias("query_bundle"),
        part("concept_id", vector_bundles).alias("vector_bundle"),
        "concept_id",
        "embedding",
    )
    schema = candidate_schema(queries.schema["query_id"].dataType)
    names = schema.fieldNames()

    def nearest(asked: pa.Table, met: pa.Table) -> pa.Table:
        ids = asked.column("query_id").combine_chunks()
        if asked.num_rows == 0 or met.num_rows == 0:
            empty = [ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=names)
        query, distance, concept = top_pairs(
            Units(asked.column("vector")),
            Units(met.column("embedding")),
            met.column("concept_id").to_numpy(),
            n,
            block_rows,
        )
        found = [ids.take(pa.array(query)), pa.array(concept), pa.array(distance)]
        return pa.Table.from_arrays(found, names=names)

    keys = ["query_bundle", "vector_bundle"]
    met = asking.groupBy(*keys).cogroup(answering.groupBy(*keys)).applyInArrow(nearest, schema)
    return best_per_query(met, n)
