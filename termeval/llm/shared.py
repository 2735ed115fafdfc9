"""Helpers that several of the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code points of text that one slice of an Arrow batch holds at most, save for
# a single longer text; bounds the numpy arrays made from it.
SLICE_CHARS = 1_000_000

# Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000

# An odd number and its inverse modulo 2**64.
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``chars`` (``SLICE_CHARS``) bytes of ``text``."""
    chars = chars or SLICE_CHARS
    for batch in batches:
        column = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + chars, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def without(df: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not in ``removed``; a row without an id stays.

    Up to ``BROADCAST_IDS`` ids are sent to every task, so that no text is dealt;
    more are joined by a shuffle.
    """
    ids = removed.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_anti")


def release() -> None:
    """Give free memory back to the system.

    Spark uses its Python workers again and again; what one task's arrays took
    would else stay with the worker while others need it.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema,
    text: str = "text",
    chars: int | None = None,
) -> DataFrame:
    """``mapInArrow`` over slices of ``chars``; ``make`` runs once per task and returns the function."""

    def run(batches):
        function = make()
        for piece in slices(batches, text, chars):
            made = function(piece)
            if made.num_rows:
                yield made
        del function
        release()

    return df.mapInArrow(run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 of all texts of ``column`` end to end, and each one's length in bytes.

    A null text has no bytes.
    """
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return b"", np.zeros(len(column), dtype=np.int64)
    return column.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes(), np.diff(offsets)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, by differences of a prefix sum."""
    n = len(points)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, ODD, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n + 1, ODD_INVERSE, dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        spans = (sums[ends] - sums[starts]) * inverse[starts]
        return mixed(spans + (ends - starts).astype(np.uint64) * ODD)


def words_of(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's begin, and their byte spans; A-Z count as a-z."""
    values = np.frombuffer(data.lower(), dtype=np.uint8)
    edges = np.cumsum(np.append(0, lengths))
    blank = (values == 32) | ((values >= 9) & (values <= 13))
    full = edges[:-1][lengths > 0]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[full] = ~blank[full]
    last = edges[1:][lengths > 0] - 1
    ends = ~blank
    ends[:-1] &= blank[1:]
    ends[last] = ~blank[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(values, starts, stops), np.searchsorted(starts, edges).tolist(), starts, stops
