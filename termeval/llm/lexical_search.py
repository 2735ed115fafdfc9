"""Ranked lexical search by dense matrix products in float64, exact.

Items are dealt into tiles, each with a compact vocabulary: the terms of its own items. A task
turns a tile of documents into a dense matrix of term impacts and multiplies it by the tile's
matrix of term weights. All numbers are whole, and vocabularies are cut so that no sum in a
product reaches 2**53, so float64 holds every one of them exactly; parts are added as 64-bit
integers. Of each tile of documents all that tie with an item's last place or beat it go on to
be ranked by score and id, so ties are decided as in a full sort.

Documents are taken apart once: what they hold of all terms asked for is written as a compact
table, from which corpus counts and scores are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.shared import buffer_of, map_slices

TOP = 10
# Terms of a pass over the documents, in bytes; more items are taken in further passes.
PASS_BYTES = 2_000_000
# Items of a tile, terms of a matrix, and documents multiplied at once.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 64, 4_096, 512
# Sums below this are exact in float64.
EXACT = 2**53
# An impact is below this: 1000000000 * tf over more than 1000 * tf.
IMPACT = 1_000_000
# Terms whose document counts travel as one row.
COUNTED = 1_024


def terms_of(data: bytes, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts as ``large_binary``, A-Z lower-cased, and the first one of each text.

    A term is a run of letters and digits of ASCII and of all other code points.
    """
    values = np.frombuffer(data.lower(), dtype=np.uint8)
    full = (values >= 0x80) | ((values >= 48) & (values <= 57)) | ((values >= 97) & (values <= 122))
    edges = np.cumsum(np.append(0, lengths))
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    first, last = edges[:-1][lengths > 0], edges[1:][lengths > 0] - 1
    begins[first], ends[last] = full[first], full[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.cumsum(np.append(0, stops - starts)).astype(np.int64)
    letters = pa.py_buffer(values[full].tobytes())
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters])
    return terms, np.searchsorted(starts, edges)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` and ``terms``, the different terms of all rows of one id."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def make():
        def run(batch):
            terms, at = terms_of(*buffer_of(batch.column("text")))
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), terms.cast(pa.binary()))
            return pa.RecordBatch.from_arrays([batch.column("item"), found], names=["item", "terms"])

        return run

    found = map_slices(rows, make, f"item {kind}, terms array<binary>")
    return found.select("item", F.explode("terms").alias("term")).distinct()


def forward(df: DataFrame, id_col: str, text_col: str, vocabulary: pa.Array) -> DataFrame:
    """``id``, ``n`` terms, and numbers (``terms``) and counts (``tf``) of those in ``vocabulary``, of each text with terms."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = shipped.value
        size = max(1, len(known))

        def run(batch):
            terms, at = terms_of(*buffer_of(batch.column("text")))
            numbers = pc.index_in(terms, value_set=known)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            hit = pc.is_valid(numbers).to_numpy(zero_copy_only=False)
            keys = row[hit] * size + numbers.drop_null().to_numpy().astype(np.int64)
            keys, counts = np.unique(keys, return_counts=True)
            edges = np.searchsorted(keys, np.arange(batch.num_rows + 1) * size)
            numbers, counts = (keys % size).astype(np.int32), counts.astype(np.int64)
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(at), pa.int64()),
                    *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (numbers, counts)),
                ],
                names=["id", "n", "terms", "tf"],
            )
            return made.filter(pc.greater(made.column("n"), 0))

        return run

    return map_slices(rows, make, f"id {kind}, n long, terms binary, tf binary")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """The documents that hold each term; counts of ``COUNTED`` terms travel as one row."""
    parts = -(-size // COUNTED)

    def count(batches):
        total = np.zeros(parts * COUNTED, dtype=np.int64)
        for batch in batches:
            held = [np.frombuffer(x, dtype=np.int32) for x in batch.column("terms").to_pylist()]
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        used = np.flatnonzero(total.reshape(parts, COUNTED).any(axis=1))
        rows = [total[p * COUNTED : (p + 1) * COUNTED].tobytes() for p in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "counts"])

    schema = "part int, counts binary"
    found = np.zeros(parts * COUNTED, dtype=np.int64)
    for row in index.select("terms").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        found[row.part * COUNTED : (row.part + 1) * COUNTED] = np.frombuffer(row.counts, dtype=np.int64)
    return found[:size]


def tiles_of(items: list[np.ndarray], weights: np.ndarray) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Tiles of items: the first item, and parts of the tile's vocabulary with their matrices of weights.

    ``items`` are term numbers. Parts end before the greatest sum an item could
    have in them reaches ``EXACT``.
    """
    made = []
    for first in range(0, len(items), TILE_ITEMS):
        own = items[first : first + TILE_ITEMS]
        terms = np.unique(np.concatenate(own))
        terms = terms[weights[terms] > 0]
        parts, at = [], 0
        while at < len(terms):
            sums = np.cumsum(weights[terms[at : at + TILE_TERMS]] * IMPACT)
            stop = at + max(1, int(np.searchsorted(sums, EXACT, side="left")))
            part = terms[at:stop]
            matrix = np.zeros((len(own), len(part)))
            for i, numbers in enumerate(own):
                matrix[i, np.isin(part, numbers)] = 1.0
            parts.append((part, matrix * weights[part]))
            at = stop
        made.append((first, parts))
    return made


def best_of(scores: np.ndarray, absent: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Row, absence of the id, id and score of the ``top`` greatest scores above 0 of each row, ties by the lesser id."""
    least = np.zeros((len(scores), 1), dtype=np.int64)
    if scores.shape[1] > top:
        least = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top:].min(axis=1, keepdims=True)
    row, place = np.nonzero((scores >= least) & (scores > 0))
    return first_of(row, absent[place], ids[place], scores[row, place], top)


def first_of(row: np.ndarray, absent: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, absent, -scores, row))
    row = row[order]
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(row)) - (starts[np.cumsum(new) - 1] if len(row) else 0)
    chosen = order[rank < top]
    return row[rank < top], absent[chosen], ids[chosen], scores[chosen]


def search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``item_id_col``, ``rank int``, ``doc_id long``, ``score long``: the ``top`` documents of each item.

    A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, its
    impact ``(1000000000 * tf) div (1000 * tf + 8 * m)`` with ``m`` of
    ``100 - 90 + (90 * n * N) div L``; a score sums weight by impact over an
    item's different terms. Documents that score 0, null and empty texts and
    texts without terms have no row, nor have items that no document meets. Equal
    scores rank by ascending id, rows without an id last. Rows that share an id
    are ranked each on its own; items that share one are one item. Ids of
    documents are integers, returned as ``doc_id``. Other columns are left out.
    """
    spark = df.sparkSession
    asked = materialise(item_terms(items, item_id_col, item_text_col), "search-terms")
    kind = asked.schema["item"].dataType.simpleString()
    schema = f"item {kind}, doc_id long, absent boolean, score long"
    total = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    passes = total // PASS_BYTES + 1
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(passes)))
    found = None
    for number in range(passes):
        part = asked.where(F.col("pass") == number).select("item", "term").toArrow()
        if not part.num_rows:
            continue
        met = _meet(spark, df, id_col, text_col, part, top, schema)
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "absent", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        F.col("item").alias(item_id_col), "rank", F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id"), "score"
    )


def _meet(spark, df: DataFrame, id_col: str, text_col: str, part: pa.Table, top: int, schema: str) -> DataFrame:
    """The best documents of each task for the items of ``part``."""
    coded = part.column("term").combine_chunks().cast(pa.large_binary()).dictionary_encode()
    vocabulary = coded.dictionary
    names = part.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.lexsort((coded.indices.to_numpy(), names.indices.to_numpy()))
    numbers, item = coded.indices.to_numpy()[order], names.indices.to_numpy()[order]
    groups = np.split(numbers, np.flatnonzero(np.diff(item)) + 1)
    index = materialise(forward(df, id_col, text_col, vocabulary), "search-index")
    counts = document_counts(index, len(vocabulary))
    n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], schema)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in counts.tolist()], dtype=np.int64)
    shipped = spark.sparkContext.broadcast((names.dictionary, groups, weights))

    def rank(batches):
        ids, items, weights = shipped.value
        tiles = tiles_of(items, weights)
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none.astype(bool), none, none) for _ in tiles]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                own = batch.slice(start, TILE_DOCS)
                absent = pc.is_null(own.column("id")).to_numpy(zero_copy_only=False)
                docs = pc.fill_null(own.column("id"), 0).to_numpy()
                held = [np.frombuffer(x, dtype=np.int32) for x in own.column("terms").to_pylist()]
                row = np.repeat(np.arange(own.num_rows), [len(x) for x in held])
                term, tf = np.concatenate(held), np.concatenate([np.frombuffer(x, dtype=np.int64) for x in own.column("tf").to_pylist()])
                n = own.column("n").to_numpy()
                m = np.array([10 + 90 * int(x) * n_docs // length for x in n.tolist()], dtype=np.int64)
                impact = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[row])
                place = np.full(len(weights), -1, dtype=np.int64)
                for i, (first, parts) in enumerate(tiles):
                    scores = np.zeros((min(TILE_ITEMS, len(items) - first), own.num_rows), dtype=np.int64)
                    for terms, matrix in parts:
                        place[terms] = np.arange(len(terms))
                        hit = place[term] >= 0
                        impacts = np.zeros((len(terms), own.num_rows))
                        impacts[place[term[hit]], row[hit]] = impact[hit]
                        place[terms] = -1
                        scores += (matrix @ impacts).astype(np.int64)
                    new = best_of(scores, absent, docs, top)
                    best[i] = first_of(*(np.concatenate(x) for x in zip(best[i], new)), top)
        for (first, _), (row, absent, docs, scores) in zip(tiles, best):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row + first)), pa.array(docs, pa.int64()), pa.array(absent), pa.array(scores, pa.int64())],
                names=["item", "doc_id", "absent", "score"],
            )

    return index.withColumn("id", F.col("id").cast("long")).mapInArrow(rank, schema)
