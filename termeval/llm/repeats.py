"""Passages that repeat across documents: a sparse suffix array of word suffixes.

Only suffixes that start at content-selected positions are kept: the position
whose ``ANCHOR`` words have the least hash among as many neighbouring positions
as fit into a passage of the least length. A passage that occurs twice has such
a position in the same place both times. The suffixes are sorted by their
first words, dealt by ranges of hashes, and compared with their neighbours.
Around those with an equal neighbour in another document every alignment of a
passage is extended to the left and right, sorted and compared the same way, so
the passages reported are exact and whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.shared import ODD, buffer_of, mixed, release, slices, words_of

# Words of the shortest passage, and of the part by which suffixes are sorted first.
PASSAGE, ANCHOR = 50, 25
BUCKETS_PER_PARTITION = 2
# Bytes of marked places that are sent to every task, and of a document besides its places. Few, so that
# texts are dealt on all but small inputs and the disk taken grows in step with the input.
BROADCAST_BYTES, ENTRY_BYTES = 1_000_000, 40
# Entries that a task gathers before it hands them on.
GATHERED = 1_000_000
# What is known of a part of a text (the hash of its words, its document and first word) and, of a whole
# passage, also which text of the document it is in and its first and last code point.
PART = {"hashes": np.uint64, "docs": np.int64, "places": np.int32}
WHOLE = PART | {"variants": np.int32, "starts": np.int32, "ends": np.int32}


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of the ``words`` words from each position on."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    found = hashes[:n].copy()
    for i in range(1, words):
        found *= ODD
        found += hashes[i : n + i]
    return mixed(found)


def selected(own: np.ndarray, window: int) -> np.ndarray:
    """Positions that have the least hash of some ``window`` neighbouring ones, the first of equals."""
    if len(own) < window:
        return np.zeros(0, dtype=np.int64)
    best = np.lib.stride_tricks.sliding_window_view(own, window).argmin(axis=1)
    return np.unique(best + np.arange(len(best)))


def _schema(kinds: dict) -> str:
    return ", ".join(["bucket int", *(f"{name} binary" for name in kinds)])


def _dealt(entries: tuple[np.ndarray, ...], kinds: dict, buckets: int, odd: int) -> pa.RecordBatch:
    """Rows of one bucket each, with the entries that belong there as bytes.

    Even buckets are dealt by hash. Odd ones are dealt by document, and hold no hashes any more.
    """
    hashes, docs, places = entries[:3]
    place = ((mixed(docs.view(np.uint64)) if odd else hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((places, docs, place)) if odd else np.argsort(place, kind="stable")
    place = place[order]
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
    spans = list(zip(edges.tolist(), [*edges[1:].tolist(), len(place)]))
    held = [x[order] for x in entries]
    if odd:
        held[0] = held[0][:0]
    columns = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in held]
    return pa.RecordBatch.from_arrays(
        [pa.array((2 * place[edges] + odd).astype(np.int32)), *columns], names=["bucket", *kinds]
    )


def _entries(batches, kinds: dict) -> tuple[np.ndarray, ...]:
    parts = {name: [np.zeros(0, dtype=kind)] for name, kind in kinds.items()}
    for batch in batches:
        for name, kind in kinds.items():
            parts[name] += [np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()]
    return tuple(np.concatenate(x) for x in parts.values())


def _gather(find, kinds: dict, buckets: int):
    """A task's loop: ``find`` yields the entries of each text; they go on in large rows.

    Entries that repeat among what the task holds are known to be repeated and
    go straight to their documents (odd buckets). Of each such hash one entry
    goes to the other tasks' (even buckets), so no hash has more entries there
    than tasks wrote rows.
    """

    def out(held):
        entries, repeated, first = _compared(tuple(np.concatenate(x) for x in zip(*held)))
        yield _dealt(tuple(x[repeated] for x in entries), kinds, buckets, 1)
        on = first | ~repeated
        yield _dealt(tuple(x[on] for x in entries), kinds, buckets, 0)

    def run(batches):
        held, size = [], 0
        for batch in slices(batches):
            for entry in find(batch):
                held.append(entry)
                size += len(entry[0])
            if size > GATHERED:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)
        held.clear()
        release()

    return run


def _compared(entries: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The entries sorted by hash; whether each is in several documents, and is the first of its hash."""
    order = np.lexsort((entries[1], entries[0]))
    entries = tuple(x[order] for x in entries)
    hashes, docs = entries[:2]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(hashes)) - 1
    several = docs[starts] != docs[stops] if len(starts) else np.zeros(0, bool)
    return entries, several[np.cumsum(first) - 1] if len(starts) else first, first


def _repeated(entries: DataFrame, kinds: dict, buckets: int) -> DataFrame:
    """The entries whose hash also occurs in another document, dealt by document."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() % 2:
            yield from batches
        else:
            found, repeated, _ = _compared(_entries(batches, kinds))
            yield _dealt(tuple(x[repeated] for x in found), kinds, buckets, 1)

    return entries.groupBy("bucket").applyInArrow(run, _schema(kinds))


def _changes(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The spans of equal neighbours."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    edges = np.flatnonzero(new).tolist()
    return list(zip(edges, [*edges[1:], n]))


def passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, anchor: int = ANCHOR
) -> DataFrame:
    """``id_col``, ``first_word``, ``n_words``, ``start``, ``end``: what a text shares with other documents.

    One row for each longest run of words all of which lie in passages of
    ``passage`` words that another document has too, words being separated by
    ASCII blanks, with A-Z as a-z. ``start`` and ``end`` are code points of the
    text. Documents without such a passage, null and empty ones, and rows with a
    null id have no row. Repeated rows of one id and text count as one document; texts
    that share an id have rows of their own, but repeat nothing of each other. Ids
    are integers; other columns are left out.

    Texts are read twice, and dealt once: to the places where a passage may repeat. The passages found
    there carry what is reported of them.
    """
    window = passage - anchor + 1
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batch):
        hashes, at, _, _ = words_of(*buffer_of(batch.column("text")))
        every = rolled(hashes, anchor)
        for doc, a, b in zip(batch.column("key").to_pylist(), at, at[1:]):
            if b - a >= passage:
                own = every[a : b - anchor + 1]
                chosen = selected(own, window)
                yield own[chosen], np.full(len(chosen), doc, dtype=np.int64), chosen.astype(np.int32)

    def by_document(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, places = _entries(batches, PART)
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        spans = _changes(docs) if len(docs) else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(docs[a]) for a, _ in spans], pa.int64()),
                pa.array([np.unique(places[a:b]).tobytes() for a, b in spans], pa.binary()),
            ],
            names=["key", "marks"],
        )

    def picked(marks: DataFrame) -> DataFrame:
        """The texts with a repeated part, each with the places of all that its document has."""
        size = marks.agg(F.sum(F.octet_length("marks") + ENTRY_BYTES)).first()[0] or 0
        few = size <= BROADCAST_BYTES
        return texts.join(F.broadcast(marks) if few else marks, "key").withColumn("variant", F.hash("text"))

    def windows(batch):
        data, lengths = buffer_of(batch.column("text"))
        hashes, at, starts, stops = words_of(data, lengths)
        every = rolled(hashes, passage)
        letters = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
        edges = letters[np.cumsum(np.append(0, lengths))].tolist()
        rows = zip(*(batch.column(x).to_pylist() for x in ("key", "variant", "marks")), at, at[1:], edges)
        for doc, variant, marks, a, b, edge in rows:
            near = np.frombuffer(marks, dtype=np.int32).astype(np.int64)[:, None] - np.arange(window)
            own = np.unique(near)
            own = own[(own >= 0) & (own <= b - a - passage)]
            yield (
                every[a + own],
                np.full(len(own), doc, dtype=np.int64),
                own.astype(np.int32),
                np.full(len(own), variant, dtype=np.int32),
                (letters[starts[a + own]] - edge).astype(np.int32),
                (letters[stops[a + own + passage - 1]] - edge).astype(np.int32),
            )

    def joined(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages that overlap or touch, as one."""
        _, docs, places, variants, starts, ends = _entries(batches, WHOLE)
        order = np.lexsort((places, variants, docs))
        docs, places, variants, starts, ends = (x[order] for x in (docs, places, variants, starts, ends))
        apart = np.cumsum(np.append(0, np.diff(places.astype(np.int64)) > passage)[: len(places)])
        spans = np.array(_changes(docs, variants, apart) if len(docs) else [], dtype=np.int64).reshape(-1, 2)
        first, last = spans[:, 0], spans[:, 1] - 1
        columns = docs[first], places[first], places[last] + np.int32(passage) - places[first], starts[first], ends[last]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    first = _repeated(texts.mapInArrow(_gather(anchors, PART, buckets), _schema(PART)), PART, buckets)
    marks = materialise(first.groupBy("bucket").applyInArrow(by_document, "key long, marks binary"), "repeat-marks")
    second = picked(marks).mapInArrow(_gather(windows, WHOLE, buckets), _schema(WHOLE))
    names = [id_col, "first_word", "n_words", "start", "end"]
    found = _repeated(second, WHOLE, buckets).groupBy("bucket").applyInArrow(
        joined, f"`{id_col}` long, first_word int, n_words int, start int, end int"
    )
    return found.distinct()
