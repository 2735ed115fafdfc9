"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts are folded (lower case, everything but letters and digits one blank). If
a text holds a benchmark item with at most k edits, then of the item's q-grams
at least ``length - q + 1 - k q`` occur there in order, on diagonals at most k
away from each other. So shared q-grams are counted in overlapping bands of
diagonals, and only regions that reach the bound are aligned, inside a band.

Longer items are searched for as a whole and in overlapping pieces, each with its own
budget of edits, so that a part of an item is found too; pieces that follow each other in a text are
joined, and where they may be the whole item, it is aligned as one. Items that are
too short for a q-gram are compared with whole texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.llm.language import _points
from termeval.llm.shared import ODD, map_slices, mixed

Q = 12
# Edits allowed per folded letter of an item.
EDIT_SHARE = 0.05
# Letters of a piece, and from one piece to the next; an item of fewer than both is one piece.
PIECE, STRIDE = 64, 32
# Letters of benchmark items sent to the tasks at once; more are searched for in further passes.
BLOCK_CHARS = 2_000_000
FILTER_BITS = 22


@lru_cache(maxsize=1)
def folds() -> np.ndarray:
    """The lower-case code point of letters and digits, a blank for all else."""
    found = np.full(0x110000, 32, dtype=np.uint32)
    for p in range(0x110000):
        if unicodedata.category(c := chr(p))[0] in "LNM":
            found[p] = ord(lower) if len(lower := c.lower()) == 1 else p
    return found


def folded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded text with runs of blanks as one, and where each letter stood."""
    own = folds()[points]
    kept = np.flatnonzero((own != 32) | np.concatenate([[False], own[:-1] != 32])) if len(own) else np.zeros(0, int)
    return own[kept], kept


def grams(own: np.ndarray) -> np.ndarray:
    """The hash of the q-gram that starts at each letter."""
    n = len(own) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # From those of 1, 2, 4 and 8 letters; Q is the sum of two of them.
    sizes = {1: own.astype(np.uint64)}
    for size in (1, 2, 4):
        h, power = sizes[size], np.uint64(pow(int(ODD), size, 1 << 64))
        sizes[2 * size] = h[:-size] * power + h[size:]
    return mixed(sizes[8][:n] * np.uint64(pow(int(ODD), 4, 1 << 64)) + sizes[4][8 : 8 + n])


def allowed(length: int) -> int:
    """The edits allowed for an item; so few that it keeps at least one q-gram."""
    return max(0, min(int(length * EDIT_SHARE), (length - Q) // Q))


def pieces(own: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Where the pieces of an item begin, and their letters: the whole, and parts, the last of which ends with it."""
    if len(own) < PIECE + STRIDE:
        return [(0, own)]
    starts = [*range(0, len(own) - PIECE, STRIDE), len(own) - PIECE]
    return [(0, own), *((a, own[a : a + PIECE]) for a in starts)]


class Index:
    """The q-grams of the pieces of some benchmark items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.names = [name for name, _ in items]
        self.whole = [own for _, own in items]
        self.short: dict[bytes, list[int]] = {}
        self.owner, self.offset, self.texts = [], [], []
        for i, own in enumerate(self.whole):
            if len(own) < Q:
                self.short.setdefault(own.tobytes(), []).append(i)
                continue
            for at, piece in pieces(own):
                self.owner.append(i)
                self.offset.append(at)
                self.texts.append(piece)
        if self.texts:
            self._index()

    def _index(self) -> None:
        self.edits = np.array([allowed(len(own)) for own in self.texts], dtype=np.int64)
        lengths = np.array([len(own) for own in self.texts], dtype=np.int64)
        self.least = np.maximum(1, lengths - Q + 1 - self.edits * Q)
        found = [grams(own) for own in self.texts]
        hashes = np.concatenate(found)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.longest = int((lengths + self.edits).max())
        self.fewest = int(self.least.min())

    def hits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram an item has too, where they lie dense enough, and its number."""
        hashes = grams(own)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        if len(at) < self.fewest:
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        real = self.hashes[place] == hashes[at]
        at, place = at[real], place[real]
        few = self.fewest - 1
        if len(at) <= few:
            return at[:0], at[:0]
        # A region holds the least number of shared q-grams within the longest item's length.
        close = np.flatnonzero(at[few:] - at[: len(at) - few] <= self.longest)
        covered = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(covered, close, 1)
        np.add.at(covered, close + few + 1, -1)
        dense = np.cumsum(covered)[:-1] > 0
        return at[dense], place[dense]

    def regions(self, own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Pieces, the diagonals between which they may be aligned, and that of the first q-gram they share."""
        at, place = self.hits(own)
        if not len(at):
            return []
        n = self.count[place]
        index = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, inside = self.item[index], self.place[index]
        diagonal = np.repeat(at, n) - inside + self.longest
        step = 2 * self.edits[item] + 1
        band = diagonal // step
        # Every band covers two steps and overlaps the next by one.
        item, inside = np.concatenate([item, item]), np.concatenate([inside, inside])
        band, diagonal = np.concatenate([band, band - 1]), np.concatenate([diagonal, diagonal]) - self.longest
        order = np.lexsort((inside, band, item))
        item, band, inside, diagonal = item[order], band[order], inside[order], diagonal[order]
        group = np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        new = group | np.concatenate([[True], inside[1:] != inside[:-1]])
        starts = np.flatnonzero(group)
        shared = np.add.reduceat(new.astype(np.int64), starts)
        full = starts[shared >= self.least[item[starts]]]
        width = 2 * self.edits[item[full]] + 1
        low = band[full] * width - self.longest
        return list(zip(item[full].tolist(), low.tolist(), (low + 2 * width).tolist(), diagonal[full].tolist()))

    def matches(self, own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Item, start and end in the folded text, and edits, of each place that holds an item or a part of one.

        The edits of a part are the most that one of its pieces has.
        """
        if len(own) < Q + 2:
            # Folded texts may end in a blank.
            plain = own[:-1] if len(own) and own[-1] == 32 else own
            return [(item, 0, len(plain), 0) for item in self.short.get(plain.tobytes(), ())]
        if not self.texts:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for piece, low, high, near in self.regions(own):
            k = int(self.edits[piece])
            found = as_it_is(self.texts[piece], own, near) or aligned(self.texts[piece], own, low - k, high + k, k)
            if found is not None:
                start, end, edits = found
                key = (piece, end // max(1, len(self.texts[piece]) // 2))
                if key not in best or edits < best[key][2]:
                    best[key] = found
        by_item: dict[int, list[tuple[int, int, int, int]]] = {}
        for (piece, _), (start, end, edits) in best.items():
            by_item.setdefault(self.owner[piece], []).append((start, end, edits, start - self.offset[piece]))
        return sorted((m for item, found in by_item.items() for m in self._joined(item, found, own)), key=lambda m: (m[1], m[0]))

    def _joined(self, item: int, found: list[tuple[int, int, int, int]], own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Pieces of one item that follow each other, as one match."""
        whole, rows = self.whole[item], []
        k = allowed(len(whole))
        for start, end, edits, diagonal in sorted(found):
            last = rows[-1] if rows else None
            if last and start <= last[1] and abs(diagonal - last[3][-1]) <= k:
                rows[-1] = (last[0], max(last[1], end), max(last[2], edits), [*last[3], diagonal])
            else:
                rows.append((start, end, edits, [diagonal]))
        out: list[tuple[int, int, int, int]] = []
        for start, end, edits, diagonals in rows:
            as_one = None
            if end - start >= len(whole) // 2 and len(whole) >= PIECE + STRIDE:
                as_one = as_it_is(whole, own, diagonals[0]) or aligned(whole, own, min(diagonals) - k, max(diagonals) + k, k)
            start, end, edits = as_one or (start, end, edits)
            if not out or (start, end) != out[-1][1:3]:
                out.append((item, start, end, edits))
        return out


def as_it_is(item: np.ndarray, own: np.ndarray, start: int) -> tuple[int, int, int] | None:
    """Start, end and no edits, if ``item`` stands at ``start`` without any."""
    end = start + len(item)
    return (start, end, 0) if start >= 0 and end <= len(own) and np.array_equal(own[start:end], item) else None


def aligned(item: np.ndarray, own: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Start, end and edits of ``item`` in ``own`` between two diagonals; ``None`` beyond ``k`` edits.

    Row i holds the edits for the item's first i letters, by diagonal. An
    alignment may start and end anywhere in the text. Each cell also carries
    where its alignment started.
    """
    m, n, width = len(item), len(own), high - low + 1
    diagonals = np.arange(width)
    far = m + n + 1
    padded = np.concatenate([own, [0]])
    ends = low + diagonals
    cost = np.where((ends >= 0) & (ends <= n), 0, far)
    start = ends.copy()
    for i in range(1, m + 1):
        at = low + diagonals + i - 1
        inside = (at >= 0) & (at < n)
        same = inside & (padded[np.where(inside, at, n)] == item[i - 1])
        down = np.append(cost[1:], far) + 1
        step = np.where(inside, cost + ~same, far)
        take = step <= down
        new = np.where(take, step, down)
        begin = np.where(take, start, np.append(start[1:], 0))
        # Letters that only the text has: the least cost so far plus the distance to it.
        best = np.minimum.accumulate(new - diagonals)
        reach = best + diagonals
        source = np.maximum.accumulate(np.where(new - diagonals == best, diagonals, 0))
        cost, start = np.where(reach < new, reach, new), np.where(reach < new, begin[source], begin)
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return None if cost[j] > k else (int(start[j]), low + j + m, int(cost[j]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``text`` and ``block``: blocks of about ``BLOCK_CHARS`` letters."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(total // BLOCK_CHARS + 1)))


def matches(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id``, ``item_id``, ``start``, ``end`` (letters of the text), ``edits``: items and parts of items in texts.

    The first column has the name ``id_col``. An item is found where its folded
    text, or ``PIECE`` letters of it, occur with at most ``EDIT_SHARE`` edits a
    letter; parts begin at every ``STRIDE`` letters of the item, so any
    ``PIECE + STRIDE`` letters hold one whole. Items shorter than ``Q`` letters
    after folding are found in texts that are equal to them after folding.
    Documents without an item have no row. Null and empty texts hold none, and
    items without letters are in none. Every item is compared with every whole text; a benchmark over
    ``BLOCK_CHARS`` letters is taken in blocks, one pass each. Repeated rows come
    out as often as they went in; other columns are left out.
    """
    blocks = _blocks(benchmark, item_id_col, item_text_col).persist()
    texts = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType
    # The id has its name at the end, as it may be that of another column.
    schema = f"key {kind}, item_id {item_kind.simpleString()}, start int, end int, edits int"
    found = None
    for (block,) in sorted(blocks.select("block").distinct().collect()):
        items = []
        for row in blocks.where(F.col("block") == block).collect():
            own, _ = folded(np.frombuffer(row.text.encode("utf-32-le"), dtype=np.uint32))
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if len(own):
                items.append((row.item, own))
        if not items:
            continue
        shipped = df.sparkSession.sparkContext.broadcast(sorted(items, key=lambda x: str(x[0])))

        def make(shipped=shipped):
            index = Index(shipped.value)

            def run(batch):
                keys, rows = [], []
                for i, points in enumerate(_points(batch)):
                    own, stood = folded(points)
                    for item, start, end, edits in index.matches(own):
                        keys.append(i)
                        rows.append((index.names[item], int(stood[start]), int(stood[end - 1]) + 1, edits))
                columns = list(zip(*rows)) or [[], [], [], []]
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(keys, pa.int64())),
                        pa.array(columns[0], batch_type),
                        *(pa.array(c, pa.int32()) for c in columns[1:]),
                    ],
                    names=["key", "item_id", "start", "end", "edits"],
                )

            return run

        batch_type = pa.string() if item_kind.simpleString() == "string" else pa.int64()
        part = map_slices(texts, make, schema)
        found = part if found is None else found.unionByName(part)
    blocks.unpersist()
    found = df.sparkSession.createDataFrame([], schema) if found is None else found
    return found.toDF(id_col, "item_id" if id_col != "item_id" else "item", "start", "end", "edits")
