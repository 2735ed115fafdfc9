"""Repeated windows of words, removed from all documents but the first: super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the least hash of any
``SEED`` words in it, so equal windows have equal minimisers. Consecutive windows that share one
travel as one string, the words they cover, to the bucket of the minimiser. There all windows
are sorted; equal ones stand together, and all but those of the least id are removed.

The same step runs twice: inside each task on what it has read, so that of equal windows only
those of one document go on, and in each bucket, which takes its strings piece by piece and
keeps only what is still the least. So a passage in any share of all documents costs a bucket
one string for each piece that tasks read, and no more memory than one string.

Windows are found equal by a hash and then compared word by word, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.llm.shared import buffer_of, map_slices, mixed, slices, span_hashes

# Words of a window, and of the parts whose least hash is its minimiser.
WINDOW, SEED = 50, 5
# Bytes of text that a task or a bucket takes together, save for a single longer text.
PIECE_BYTES = 8_000_000
# Bytes of the input for each bucket; its strings are about three times as long.
BUCKET_BYTES = 4_000_000
# Stands for a missing id: greater than all others.
LAST = 2**63 - 1
SCHEMA = "bucket long, docs binary, texts binary, firsts binary, counts binary, size int, strings binary"


class Strings(NamedTuple):
    """Strings end to end, their lengths in bytes, and of each the document, the text and its first word's number."""

    data: bytes
    sizes: np.ndarray
    docs: np.ndarray
    texts: np.ndarray
    firsts: np.ndarray


class Runs(NamedTuple):
    """Runs of words to be removed: document, text, first word and the one after the last."""

    docs: np.ndarray
    texts: np.ndarray
    firsts: np.ndarray
    ends: np.ndarray


def word_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are no blanks, where words begin and end, and the first word of each string."""
    values = np.frombuffer(data, dtype=np.uint8)
    edges = np.cumsum(np.append(0, sizes))
    full = ~((values == 32) | ((values >= 9) & (values <= 13)))
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    begins[edges[:-1][sizes > 0]] = full[edges[:-1][sizes > 0]]
    ends[edges[1:][sizes > 0] - 1] = full[edges[1:][sizes > 0] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return full, starts, stops, np.searchsorted(starts, edges)


def numbered(letters: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words only, and a hash of it that all tasks share."""
    offsets = np.cumsum(np.append(0, lengths)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    known, sizes = buffer_of_binary(coded.dictionary)
    edges = np.cumsum(np.append(0, sizes))
    hashes = span_hashes(np.frombuffer(known, dtype=np.uint8), edges[:-1], edges[1:])
    numbers = coded.indices.to_numpy()
    return numbers, hashes[numbers]


def buffer_of_binary(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All values of a ``large_binary`` column without nulls end to end, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return b"", np.zeros(len(column), dtype=np.int64)
    return column.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes(), np.diff(offsets)


def least_from(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    found, span = values, 1
    while 2 * span <= width:
        found, span = np.minimum(found[:-span], found[span:]), 2 * span
    rest = width - span
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def least_docs(numbers: np.ndarray, hashes: np.ndarray, begins: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """The least document of all windows equal to each of those at ``begins``."""
    names = span_hashes(hashes, begins, begins + window)
    order = np.lexsort((docs, names))
    names, sorted_docs = names[order], docs[order]
    first = np.concatenate([[True], names[1:] != names[:-1]])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    others = np.flatnonzero(~first)
    one, other = begins[order[others]], begins[order[head[others]]]
    differ = np.zeros(len(others), dtype=bool)
    for i in range(window):
        differ |= numbers[one + i] != numbers[other + i]
    least = np.empty_like(docs)
    least[order] = sorted_docs[head]
    if differ.any():
        # Different windows of one hash: those of its group are sorted by their words.
        mixed_up = np.flatnonzero(np.isin(head, head[others[differ]]))
        rows = numbers[begins[order[mixed_up]][:, None] + np.arange(window)]
        _, group = np.unique(rows, axis=0, return_inverse=True)
        found = np.full(group.max() + 1, LAST)
        np.minimum.at(found, group.ravel(), sorted_docs[mixed_up])
        least[order[mixed_up]] = found[group.ravel()]
    return least


def met(strings: Strings, window: int, seed: int) -> tuple[Runs, Strings, np.ndarray]:
    """What is removed, what goes on (as strings of windows that share a minimiser), and those minimisers."""
    full, starts, stops, at = word_spans(strings.data, strings.sizes)
    string = np.repeat(np.arange(len(strings.sizes)), np.diff(at))
    begins = np.flatnonzero(at[1:][string] - np.arange(len(starts)) >= window)
    if not len(begins):
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none), Strings(b"", none, none, none, none), none.astype(np.uint64)
    letters = np.frombuffer(strings.data, dtype=np.uint8)[full].tobytes()
    numbers, hashes = numbered(letters, stops - starts)
    places = np.arange(len(starts) - seed + 1)
    minimisers = least_from(span_hashes(hashes, places, places + seed), window - seed + 1)[begins]
    own = string[begins]
    docs = strings.docs[own]
    removed = docs > least_docs(numbers, hashes, begins, docs, window)

    def runs(chosen: np.ndarray, *kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of ``chosen`` that follow each other, in one string and alike in ``kinds``."""
        apart = np.diff(begins[chosen]) != 1
        for kind in (own, *kinds):
            apart |= np.diff(kind[chosen].view(np.int64)) != 0
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1]) if len(chosen) else np.zeros(0, dtype=np.int64)
        return chosen[edges], chosen[np.append(edges[1:], len(chosen)) - 1] if len(chosen) else edges

    def number(of: np.ndarray) -> np.ndarray:
        return strings.firsts[own[of]] + begins[of] - at[own[of]]

    a, b = runs(np.flatnonzero(removed))
    gone = Runs(docs[a], strings.texts[own[a]], number(a), number(b) + window)
    a, b = runs(np.flatnonzero(~removed), minimisers)
    low, high = starts[begins[a]], stops[begins[b] + window - 1]
    data = b"".join([strings.data[x:y] for x, y in zip(low.tolist(), high.tolist())])
    return gone, Strings(data, high - low, docs[a], strings.texts[own[a]], number(a)), minimisers[a]


def _spans(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_keys):
        return []
    edges = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _packed_strings(strings: Strings, minimisers: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket (even numbers)."""
    place = (mixed(minimisers) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    edges = np.cumsum(np.append(0, strings.sizes))
    low, high = edges[:-1][order].tolist(), edges[1:][order].tolist()
    columns = [x[order].astype(np.int64) for x in (strings.docs, strings.texts, strings.firsts, strings.sizes)]
    rows = [[] for _ in range(7)]
    for a, b in _spans(place[order]):
        raw = b"".join([strings.data[x:y] for x, y in zip(low[a:b], high[a:b])])
        made = (2 * int(place[order[a]]), *(x[a:b].tobytes() for x in columns), len(raw), pa.compress(raw, "zstd", asbytes=True))
        for row, value in zip(rows, made):
            row.append(value)
    return _batch(rows)


def _packed_runs(runs: Runs, buckets: int) -> pa.RecordBatch:
    """One row for each bucket of documents (odd numbers)."""
    place = (mixed(runs.docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    columns = [x[order].astype(np.int64) for x in runs]
    rows = [[] for _ in range(7)]
    for a, b in _spans(place[order]):
        made = (2 * int(place[order[a]]) + 1, *(x[a:b].tobytes() for x in columns), 0, b"")
        for row, value in zip(rows, made):
            row.append(value)
    return _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.binary())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)


def _unpacked(batch: pa.RecordBatch) -> Iterator[list[np.ndarray | bytes]]:
    columns = [batch.column(i).to_pylist() for i in range(1, 7)]
    for docs, texts, firsts, counts, size, strings in zip(*columns):
        yield [*(np.frombuffer(x, dtype=np.int64) for x in (docs, texts, firsts, counts)), size, strings]


def repeated(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc``, ``name``, ``first``, ``end``: runs of words that windows of a lesser ``doc`` cover.

    ``texts`` has ``doc long``, ``name long`` (one for each text of a document) and ``text``.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // BUCKET_BYTES + 1

    def gather(batches):
        held, size = [], 0

        def out():
            data, sizes = buffer_of(pa.concat_arrays([x.column("text") for x in held]))
            docs, names = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("doc", "name"))
            texts_ = distinct(Strings(data, sizes, docs, names, np.zeros(len(docs), dtype=np.int64)))
            runs, strings, minimisers = met(texts_, window, seed)
            yield _packed_strings(strings, minimisers, buckets)
            yield _packed_runs(runs, buckets)

        for batch in slices(batches):
            held.append(batch)
            size += pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
            if size >= PIECE_BYTES:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown(runs: Runs) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(runs, kinds)], names=["doc", "name", "first", "end"]
            )

        held, size, bound = [], 0, PIECE_BYTES
        for batch in batches:
            for docs, names, firsts, counts, length, strings in _unpacked(batch):
                if key[0].as_py() % 2:
                    yield shown(Runs(docs, names, firsts, counts))
                    continue
                held.append(Strings(pa.decompress(strings, length, "zstd", asbytes=True), counts, docs, names, firsts))
                size += length
                if size >= bound:
                    runs, left, _ = met(_joined(held), window, seed)
                    yield shown(runs)
                    # What is left is met again only after as much has come.
                    held, size = [left], len(left.data)
                    bound = size + max(size, PIECE_BYTES)
        if size:
            yield shown(met(_joined(held), window, seed)[0])

    packed = texts.mapInArrow(gather, SCHEMA)
    return packed.groupBy("bucket").applyInArrow(meet, "doc long, name long, first int, end int")


def _joined(held: list[Strings]) -> Strings:
    return distinct(Strings(b"".join(x.data for x in held), *(np.concatenate(x) for x in list(zip(*held))[1:])))


def distinct(strings: Strings) -> Strings:
    """Each string once; those of repeated rows are alike in document, text, place and length."""
    columns = strings[1:]
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    if new.all():
        return strings
    kept = np.sort(order[new])
    edges = np.cumsum(np.append(0, strings.sizes))
    data = b"".join([strings.data[a:b] for a, b in zip(edges[:-1][kept].tolist(), edges[1:][kept].tolist())])
    return Strings(data, *(x[kept] for x in columns))


def remove(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """``id_col``, ``n_words long``, ``n_removed long``, ``kept string`` of every text.

    Words are separated by ASCII blanks and compared as they are. A word is
    removed if it lies in a window of ``window`` words that also begins in a
    document with a lesser id; ``kept`` has the others, joined by one blank.
    Windows are those of the whole input. Ids are integers. Null and empty texts
    have no words; texts shorter than a window lose none. A null id is greater
    than all others; rows that share an id, or have none, are one document, whose
    texts take nothing from each other. Repeated rows come out as often as they
    went in. Other columns are left out.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed has at least one word and at most those of a window")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(
        "id", F.coalesce("id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("name"), "text"
    )
    found = repeated(rows.select("doc", "name", "text").where(F.length("text") >= 2 * window - 1), window, seed)
    gone = found.groupBy("doc", "name").agg(F.collect_list(F.struct("first", "end")).alias("gone"))

    def make():
        def run(batch):
            out = [[], [], []]
            for text, own in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                words = (text or "").encode().split()
                left = np.ones(len(words), dtype=bool)
                for x in own or ():
                    left[x["first"] : x["end"]] = False
                n = int(np.count_nonzero(left))
                kept = words if n == len(words) else [words[i] for i in np.flatnonzero(left)]
                for column, value in zip(out, (len(words), len(words) - n, b" ".join(kept).decode())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=[id_col, "n_words", "n_removed", "kept"],
            )

        return run

    joined = rows.join(gone, ["doc", "name"], "left").select("id", "text", "gone")
    return map_slices(joined, make, f"`{id_col}` long, n_words long, n_removed long, kept string")
