"""Approximate nearest vectors by an index of cells, stored as tables.

Vectors are assigned to the nearest of some centroids, their cell; cells are stored in blocks
of bounded size. A query probes the cells whose centroids are nearest to it and ranks their
vectors exactly, by the same function as the exact search, so only what lies in other cells can
be missed. How many cells a query probes is measured when the index is built: the exact
neighbours of some vectors are looked up, and the least number of cells is kept that holds the
wanted share of them. Vectors without clusters need many cells, clustered ones few.

The centroids are fitted to a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termeval.durable import stored_path
from termeval.operators.vector_blocks import (
    BLOCK_ELEMENTS,
    BUNDLE_BYTES,
    TILE_ROWS,
    Nearest,
    Units,
    best_per_query,
    bundles,
    candidate_schema,
    first_n,
    list_matrix,
    merge_top,
    top_pairs,
    unit_rows,
)
from termeval.operators.vectors import BROADCAST_BYTES, BROADCAST_QUERIES, nearest_vectors

# Vectors the centroids are fitted to, and rounds of the fit.
SAMPLE_ROWS, ROUNDS = 20_000, 12
# Cells at most; their centroids are sent to every task.
MOST_CELLS = 4_096
# Vectors of a block at most; a large cell has several.
BLOCK_ROWS = 32_768
# Vectors whose exact neighbours tell how many cells to probe, and how many neighbours each.
MEASURED, NEIGHBOURS = 200, 10


@dataclass
class VectorIndex:
    """``vectors (cell, block, concept_id, embedding)`` and the centroids of the cells.

    ``probes`` is the number of cells a query probes by default, ``recall`` the
    share of exact neighbours that so many cells held when it was measured.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    blocks: dict[int, int]
    probes: int
    recall: float

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """An index that :func:`build` wrote."""
        row = spark.read.parquet(f"{path}/head").first()
        centroids = np.array(json.loads(row.centroids))
        blocks = {int(k): v for k, v in json.loads(row.blocks).items()}
        return cls(spark, path, centroids, blocks, row.probes, row.recall)

    def search(self, queries: DataFrame, n: int = 5, probes: int | None = None) -> DataFrame:
        """``(query_id, rank, concept_id, score)`` of the ``n`` nearest vectors of the probed cells.

        ``queries`` holds unique ``query_id`` and a ``vector``. With as many
        ``probes`` as cells the answer is exact. Queries without a direction
        (NULL, of length 0, with an element that is no finite number) have no
        row, and no such vector is found. A query set of checked small size is
        sent to the tasks that scan the probed cells; a larger one is dealt to
        bundles of cells.
        """
        probes = min(len(self.centroids), probes or self.probes)
        rows = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
        few = rows.limit(BROADCAST_QUERIES + 1).toArrow()
        if few.num_rows <= BROADCAST_QUERIES and few.nbytes <= BROADCAST_BYTES:
            return best_per_query(self._scan(few, n, probes, rows.schema["query_id"].dataType), n)
        return best_per_query(self._dealt(rows, n, probes), n)

    def _scan(self, rows: pa.Table, n: int, probes: int, kind) -> DataFrame:
        ids, units = rows.column("query_id").combine_chunks(), unit_rows(list_matrix(rows.column("vector")))
        proper = np.flatnonzero(np.isfinite(units).all(axis=1))
        ids, units = ids.take(pa.array(proper)), units[proper]
        near = nearest_cells(units, self.centroids, probes)
        shared = self.spark.sparkContext.broadcast((ids, units, near))

        def best_of_task(batches):
            query_ids, query_units, near = shared.value
            asked = {cell: np.flatnonzero((near == cell).any(axis=1)) for cell in np.unique(near).tolist()}
            best = None
            for batch in batches:
                cells, concepts = batch.column("cell").to_numpy(), batch.column("concept_id").to_numpy()
                units = unit_rows(list_matrix(batch.column("embedding")))
                for cell in np.unique(cells).tolist():
                    if cell not in asked:
                        continue
                    at = np.flatnonzero(cells == cell)
                    query, distance, concept = top_pairs(query_units[asked[cell]], units[at], concepts[at], n)
                    found = asked[cell][query], distance, concept
                    best = first_n(*found, n) if best is None else merge_top(best, found, n)
            if best is not None:
                query, distance, concept = best
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(query)), pa.array(concept), pa.array(distance)],
                    names=["query_id", "concept_id", "score"],
                )

        cells = np.unique(near).tolist()
        chosen = self.vectors if len(cells) == len(self.centroids) else self.vectors.filter(F.col("cell").isin(cells))
        met = chosen.filter("cell >= 0").select("cell", "concept_id", "embedding")
        return met.mapInArrow(best_of_task, candidate_schema(kind))

    def _dealt(self, queries: DataFrame, n: int, probes: int, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
        """Queries are copied to the bundles of blocks that hold a cell they probe, with a bit for each block."""
        kind, width = queries.schema["query_id"].dataType, self.centroids.shape[1]
        asking = queries.count()
        query_parts = bundles(asking, width, -(-asking // TILE_ROWS), bundle_bytes)
        stored = self.vectors.filter("cell >= 0")
        sizes = sorted(tuple(row) for row in stored.groupBy("cell", "block").count().collect())
        rows = np.array([size for _, _, size in sizes], dtype=np.int64)
        share = -(-rows.sum() // bundles(int(rows.sum()), width, len(sizes), bundle_bytes))
        # A block belongs to the bundle that its first row falls into.
        bundle = (np.cumsum(rows) - rows) // max(1, share)
        members = [np.flatnonzero(bundle == x) for x in np.unique(bundle)]
        cells_of = [np.array([sizes[i][0] for i in member]) for member in members]
        places = [(*sizes[i][:2], k, j) for k, member in enumerate(members) for j, i in enumerate(member.tolist())]
        shared = self.spark.sparkContext.broadcast((self.centroids, cells_of))

        def place(batches):
            centroids, cells_of = shared.value
            step = max(1, BLOCK_ELEMENTS // max(1, len(centroids)))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    some = batch.slice(start, step)
                    units = unit_rows(list_matrix(some.column("vector")))
                    proper = np.flatnonzero(np.isfinite(units).all(axis=1))
                    probed = np.zeros((len(proper), len(centroids)), dtype=bool)
                    np.put_along_axis(probed, nearest_cells(units[proper], centroids, probes), True, axis=1)
                    for number, cells in enumerate(cells_of):
                        asked = np.flatnonzero(probed[:, cells].any(axis=1))
                        if not len(asked):
                            continue
                        bits = np.packbits(probed[np.ix_(asked, cells)], axis=1)
                        placed = some.take(pa.array(proper[asked]))
                        columns = [
                            pa.array(np.full(len(asked), number), pa.int32()),
                            pa.array([row.tobytes() for row in bits], pa.binary()),
                            placed.column("query_id"),
                            placed.column("vector"),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["bundle", "bits", "query_id", "vector"])

        vector_kind = queries.schema["vector"].dataType.simpleString()
        schema = f"bundle int, bits binary, query_id {kind.simpleString()}, vector {vector_kind}"
        asking = queries.mapInArrow(place, schema).withColumn(
            "part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")
        )
        every = F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))
        placing = self.spark.createDataFrame(places, "cell int, block int, bundle int, place int")
        answering = stored.join(F.broadcast(placing), ["cell", "block"]).select(
            "bundle", every.alias("part"), "place", "concept_id", "embedding"
        )
        schema = candidate_schema(kind)

        def nearest(asked: pa.Table, met: pa.Table) -> pa.Table:
            ids = asked.column("query_id").combine_chunks()
            if asked.num_rows == 0 or met.num_rows == 0:
                empty = [ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())]
                return pa.Table.from_arrays(empty, names=schema.fieldNames())
            places, concepts = met.column("place").to_numpy(), met.column("concept_id").to_numpy()
            units = Units(met.column("embedding"))
            order = np.argsort(places, kind="stable")
            numbers, starts = np.unique(places[order], return_index=True)
            ends = np.r_[starts[1:], len(places)]
            found = []
            for start in range(0, asked.num_rows, TILE_ROWS):
                some = asked.slice(start, TILE_ROWS)
                near = Nearest(unit_rows(list_matrix(some.column("vector"))), n)
                bits = np.frombuffer(b"".join(some.column("bits").to_pylist()), dtype=np.uint8)
                probed = np.unpackbits(bits.reshape(some.num_rows, -1), axis=1).astype(bool)
                for number, first, last in zip(numbers.tolist(), starts.tolist(), ends.tolist()):
                    probing = np.flatnonzero(probed[:, number])
                    for at in range(first, last, TILE_ROWS) if len(probing) else ():
                        rows = order[at : min(at + TILE_ROWS, last)]
                        near.meet(units.take(rows), concepts[rows], probing)
                query, distance, concept = near.best
                found.append((query + start, distance, concept))
            query, distance, concept = (np.concatenate(parts) for parts in zip(*found))
            found = [ids.take(pa.array(query)), pa.array(concept), pa.array(distance)]
            return pa.Table.from_arrays(found, names=schema.fieldNames())

        keys = ["bundle", "part"]
        return asking.groupBy(*keys).cogroup(answering.groupBy(*keys)).applyInArrow(nearest, schema)


def own_cells(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row."""
    step = max(1, BLOCK_ELEMENTS // max(1, len(centroids)))
    own = [(units[at : at + step] @ centroids.T).argmax(axis=1) for at in range(0, len(units), step)]
    return np.concatenate(own) if own else np.zeros(0, dtype=np.int64)


def nearest_cells(units: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest centroids of each row, nearest first."""
    return np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]


def fitted(units: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit length by rounds of assignment and means, from rows spread over the sample."""
    centroids = units[np.linspace(0, len(units) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = own_cells(units, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        # A cell that lost all of its vectors stays where it was.
        centroids = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1.0), centroids)
    return centroids


def build(
    vectors: DataFrame, path: str | None = None, cells: int | None = None, recall: float = 0.95, n: int = NEIGHBOURS
) -> VectorIndex:
    """Index ``(concept_id, embedding)``, as tables below ``path``.

    ``concept_id`` is unique. ``cells`` is by default the root of the number of
    vectors. ``recall`` is the share of the ``n`` nearest vectors that the probed
    cells should hold; the number of cells is measured on ``MEASURED`` of the
    vectors, against the exact search over all. Rows without a direction are
    stored in a cell of their own, numbered -1, which no query probes.
    """
    spark = vectors.sparkSession
    path = (path or stored_path(spark, "vector-index")).rstrip("/")
    rows = vectors.select("concept_id", "embedding").filter(F.col("embedding").isNotNull())
    length = F.aggregate("embedding", F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double"))
    proper = rows.filter(length.isNotNull() & (length > 0) & (length < F.lit(float("inf"))))
    total = proper.count()
    cells = max(1, min(MOST_CELLS, total, cells or math.isqrt(total)))
    drawn = proper.orderBy(F.xxhash64("concept_id"), "concept_id").limit(SAMPLE_ROWS).toArrow()
    sample = unit_rows(list_matrix(drawn.column("embedding")))
    centroids = fitted(sample, cells) if total else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            # Rows may be of no direction, so they are not all of one width.
            cell = np.full(batch.num_rows, -1, dtype=np.int32)
            proper = np.flatnonzero(batch.column("proper").to_numpy(zero_copy_only=False).astype(bool))
            if len(proper):
                units = unit_rows(list_matrix(batch.column("embedding").take(pa.array(proper))))
                cell[proper] = own_cells(units, shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), batch.column("concept_id"), batch.column("embedding")], names=["cell", "concept_id", "embedding"]
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    is_proper = F.coalesce((length > 0) & (length < F.lit(float("inf"))), F.lit(False))
    assigned = rows.withColumn("proper", is_proper).mapInArrow(assign, f"cell int, concept_id long, embedding {kind}")
    assigned.write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    counts = {r.cell: r["count"] for r in assigned.groupBy("cell").count().collect()}
    blocks = {cell: -(-size // BLOCK_ROWS) for cell, size in counts.items()}
    sizes = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    # Cells lie together in the files, so that a scan of some skips the others.
    placed = assigned.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("concept_id"), F.col("blocks")).cast("int")
    )
    placed = placed.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
    placed.select("cell", "block", "concept_id", "embedding").write.parquet(f"{path}/vectors")
    probes, measured = _measured(spark, spark.read.parquet(f"{path}/vectors"), drawn, centroids, recall, n)
    head = [(json.dumps(centroids.tolist()), json.dumps(blocks), probes, measured)]
    spark.createDataFrame(head, "centroids string, blocks string, probes int, recall double").coalesce(1).write.parquet(
        f"{path}/head"
    )
    return VectorIndex(spark, path, centroids, blocks, probes, measured)


def _measured(spark, vectors: DataFrame, drawn: pa.Table, centroids: np.ndarray, recall: float, n: int) -> tuple[int, float]:
    """The least number of cells that hold the wanted share of exact neighbours, and the share they hold."""
    asked = drawn.slice(0, MEASURED)
    if not asked.num_rows:
        return 1, 1.0
    queries = spark.createDataFrame(asked.rename_columns(["query_id", "vector"]))
    # Each vector is its own nearest one, which tells nothing.
    exact = nearest_vectors(queries, vectors.filter("cell >= 0"), n + 1).filter("query_id != concept_id")
    found = exact.join(vectors.select("concept_id", "cell"), "concept_id").select("query_id", "cell").toArrow()
    units = unit_rows(list_matrix(asked.column("embedding")))
    near = nearest_cells(units, centroids, len(centroids))
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(near.shape[1])[None], axis=1)
    row = {q: i for i, q in enumerate(asked.column("concept_id").to_pylist())}
    rows = [row[q] for q in found.column("query_id").to_pylist()]
    if not rows:
        return 1, 1.0
    ranks = place[rows, found.column("cell").to_numpy()]
    held = np.cumsum(np.bincount(ranks, minlength=len(centroids))) / len(ranks)
    probes = int(np.searchsorted(held, recall)) + 1
    return probes, float(held[probes - 1])
