"""Ranking of vectors in matrix blocks, as used inside and around tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Distances are ranked at this many decimals, so that rounding in the last bits
# never decides between vectors that tie; ties go to the smaller concept id.
RANK_DECIMALS = 12
# More than rounding to so many decimals can bring two distances together.
MARGIN = 2e-12

# Distances computed at a time (8 MiB of doubles), and vectors of those at most.
BLOCK_ELEMENTS = 1024 * 1024
TILE_ROWS = 4096

# Bytes of vectors, as doubles, that a task holds of either side.
BUNDLE_BYTES = 32 * 1024 * 1024
# Bundles of a side at least, if there are so many blocks, so that many tasks share the work.
LEAST_BUNDLES = 6


def bundles(rows: int, width: int, blocks: int, bundle_bytes: int = BUNDLE_BYTES) -> int:
    """How many bundles ``rows`` vectors in ``blocks`` are dealt in, so that one is of bounded size."""
    return max(1, min(LEAST_BUNDLES, blocks), -(-rows * max(1, width) * 8 // bundle_bytes))


def best_per_query(candidates: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", RANK_DECIMALS), "concept_id"
    )
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("query_id", "rank", "concept_id", "score")
    )


def candidate_schema(query_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id),
            T.StructField("concept_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def list_matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    width = int(lengths[0]) if len(lengths) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; rows without length become NaN."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0.0, np.nan, lengths)


class Units:
    """The unit rows of an Arrow column of vectors; only slices that are asked for are made of doubles."""

    def __init__(self, column):
        self.column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = pc.min_max(pc.list_value_length(self.column)).as_py()
        if lengths["min"] != lengths["max"]:
            raise ValueError("vectors differ in length")
        self.shape = len(self.column), lengths["max"] or 0

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, rows: slice) -> np.ndarray:
        return unit_rows(list_matrix(self.column[rows]))

    def take(self, rows: np.ndarray) -> np.ndarray:
        return unit_rows(list_matrix(self.column.take(pa.array(rows))))


class Nearest:
    """The ``n`` nearest rows to each of some queries, among those met so far.

    ``best`` is (query, distance, id) in order; ``bound`` is the distance of the
    last of a query's ``n``, beyond which no row is kept.
    """

    def __init__(self, queries: np.ndarray, n: int):
        self.queries, self.n = queries, n
        self.best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bound = np.full(len(queries), np.inf)

    def meet(self, units: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compare ``units`` with all queries, or with those numbered ``asked``."""
        queries = self.queries if asked is None else self.queries[asked]
        bound = self.bound if asked is None else self.bound[asked]
        step = max(1, BLOCK_ELEMENTS // max(1, min(len(units), TILE_ROWS)))
        for at in range(0, len(units), TILE_ROWS):
            tile, tile_ids = units[at : at + TILE_ROWS], ids[at : at + TILE_ROWS]
            found = [(np.zeros(0, np.int64), np.zeros(0), tile_ids[:0])]
            for start in range(0, len(queries), step):
                distance = 1.0 - queries[start : start + step] @ tile.T
                query, row = np.nonzero(self._near(distance, bound[start : start + step]))
                found.append(first_n(query + start, distance[query, row], tile_ids[row], self.n))
            query, distance, concept = (np.concatenate(parts) for parts in zip(*found))
            if not len(query):
                continue
            query = query if asked is None else asked[query]
            self.best = merge_top(self.best, (query, distance, concept), self.n)
            self._set_bound()
            bound = self.bound if asked is None else self.bound[asked]

    def _near(self, distance: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a row may be among the ``n`` nearest; what rounding could bring there is kept."""
        if not np.isfinite(bound).all():
            ranked = np.where(np.isnan(distance), np.inf, distance)
            if ranked.shape[1] <= self.n:
                return ranked <= bound[:, None] + MARGIN
            last = np.partition(ranked, self.n - 1, axis=1)[:, self.n - 1]
            return ranked <= np.minimum(last, bound)[:, None] + MARGIN
        return distance <= bound[:, None] + MARGIN

    def _set_bound(self) -> None:
        query, distance, _ = self.best
        counts = np.bincount(query, minlength=len(self.queries))
        full = np.flatnonzero(counts == self.n)
        last = distance[np.cumsum(counts)[full] - 1]
        self.bound[full] = np.round(np.where(np.isnan(last), np.inf, last), RANK_DECIMALS)


def top_pairs(queries: np.ndarray | Units, units: np.ndarray | Units, ids: np.ndarray, n: int, rows: int = TILE_ROWS):
    """The ``n`` nearest rows of ``units`` to each query: (query, distance, id).

    At most ``rows`` queries meet as many rows of ``units`` at a time.
    """
    if queries.shape[1] != units.shape[1]:
        raise ValueError("vectors differ in length")
    rows = min(rows, TILE_ROWS)
    found = []
    for start in range(0, len(queries), rows):
        nearest = Nearest(queries[start : start + rows], n)
        for at in range(0, len(units), rows):
            nearest.meet(units[at : at + rows], ids[at : at + rows])
        query, distance, concept = nearest.best
        found.append((query + start, distance, concept))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def merge_top(a, b, n: int):
    return first_n(*(np.concatenate(parts) for parts in zip(a, b)), n)


def first_n(query: np.ndarray, distance: np.ndarray, ids: np.ndarray, n: int):
    """Order by query, rounded distance and id; keep ``n`` per query."""
    ranked = np.round(np.where(np.isnan(distance), np.inf, distance), RANK_DECIMALS)
    order = np.lexsort((ids, ranked, query))
    query = query[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
    position = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    order = order[position < n]
    return query[position < n], distance[order], ids[order]
