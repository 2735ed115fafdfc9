"""Byte-level BPE: encoding by forced boundaries, and decoding.

The vocabulary file is a JSON document of the tokenizers library. A text is cut
at the file's added tokens, then by the public pre-token pattern, then between
every two bytes that stand side by side in no token of the vocabulary: no merge
can ever join them, so the fragments are encoded one by one and their ids
concatenated. Fragments repeat, so each task remembers the pre-tokens it has
seen in a store of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.llm.shared import buffer_of, map_slices, span_hashes

# Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Pre-tokens a task remembers, and the longest one worth remembering.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 48

# Bytes of text that are encoded at once, save for a single longer text.
ENCODED_CHARS = 300_000

# Fragments up to so many bytes are merged together, longer ones one by one.
LONG = 32
NO_PAIR = 2**62
PAD = 2**32 - 1
LETTER, NUMBER, SPACE, OTHER = range(4)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_kinds() -> np.ndarray:
    """For each code point whether the pattern takes it as letter, number, white space or other."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for first in range(0, 0x110000, 0x10000):
        points = [p for p in range(first, first + 0x10000) if not 0xD800 <= p < 0xE000]
        text = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                kinds[points[m.start()] : points[m.end() - 1] + 1] = kind
    return kinds


def gathered(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``values`` end to end, and the edges between them."""
    lengths = ends - starts
    edges = np.cumsum(np.append(0, lengths))
    index = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], lengths)
    return values[index], edges


def replaced(ids: np.ndarray, n: np.ndarray, words: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with those of ``words`` replaced by one id each."""
    at = np.cumsum(np.append(0, n))
    keep = np.ones(len(ids), dtype=bool)
    for word, i in zip(words.tolist(), by.tolist()):
        keep[at[word] + 1 : at[word + 1]] = False
        ids[at[word]] = i
    n = n.copy()
    n[words] = 1
    return ids[keep], n


class Pool:
    """Byte strings end to end, to be put together by arrays of indices."""

    def __init__(self, strings: list[bytes]):
        self.values = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.edges = np.cumsum([0, *map(len, strings)])

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ``ids``, and the edges between groups of ``counts`` ids."""
        values, edges = gathered(self.values, self.edges[ids], self.edges[ids + 1])
        return values.tobytes(), edges[np.cumsum(np.append(0, counts))].tolist()


class Seen:
    """The ids of pre-tokens met before, by their hash, in sorted arrays of bounded size."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.n = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` are not held; room is made for them."""
        place = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        held[inside] = self.keys[place[inside]] == keys[inside]
        if len(self.keys) + np.count_nonzero(~held) > REMEMBERED and len(self.keys):
            self.clear()
            return np.arange(len(keys))
        return np.flatnonzero(~held)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(n) - n
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.n = np.insert(self.n, place, n)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def look(self, keys: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``keys[inverse]`` end to end, and how many each has."""
        place = np.searchsorted(self.keys, keys)[inverse]
        at, n = self.at[place], self.n[place]
        return gathered(self.ids, at, at + n)[0].astype(np.int64), n

    def forget(self, first: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> None:
        """Drop everything once a pre-token too long to be kept was added."""
        if np.any(lengths[first] > REMEMBERED_LENGTH) and len(self.ids) > 16 * REMEMBERED:
            self.clear()


class PairTable:
    """Ranks of id pairs, looked up for whole arrays.

    A pair's slot is a multiplicative hash; pairs whose slot is taken move to a
    smaller table with another multiplier, until none is left.
    """

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.joined = np.array([joined for _, joined in merges.values()], dtype=np.int64)
        keys = np.array([left << 32 | right for left, right in merges], dtype=np.uint64)
        ranks = np.array([rank for rank, _ in merges.values()], dtype=np.int64)
        self.levels = []
        bits = max(8, int(len(keys)).bit_length() + 4)
        while len(keys):
            multiplier = np.uint64(self.MULTIPLIERS[len(self.levels) % 4])
            slots = (keys * multiplier) >> np.uint64(64 - bits)
            _, firsts = np.unique(slots, return_index=True)
            held = np.full(1 << bits, np.uint64(2**64 - 1))
            rank_of = np.full(1 << bits, NO_PAIR, dtype=np.int64)
            held[slots[firsts]], rank_of[slots[firsts]] = keys[firsts], ranks[firsts]
            self.levels.append((multiplier, np.uint64(64 - bits), held, rank_of))
            keys, ranks = np.delete(keys, firsts), np.delete(ranks, firsts)
            bits = max(8, int(len(keys)).bit_length() + 4)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NO_PAIR`` where the two are never joined."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(keys.shape, NO_PAIR, dtype=np.int64)
        for multiplier, shift, held, rank_of in self.levels:
            slots = (keys * multiplier) >> shift
            hit = held[slots] == keys
            found[hit] = rank_of[slots[hit]]
        return found


class ByteBPE:
    """A byte-level BPE vocabulary, ready to encode and decode."""

    def __init__(self, document: str):
        described = json.loads(document)
        model, letters = described["model"], byte_letters()
        added = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        ids = {token: i for token, i in model["vocab"].items() if token not in added}
        spelled = {token: bytes(letters[c] for c in token) for token in ids}
        size = max([*ids.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = spelled[token]
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.texts = [str(i) for i in range(size)]
        self.added = added
        self.single = np.zeros(256, dtype=np.int64)
        for token, spelling in spelled.items():
            if len(spelling) == 1:
                self.single[spelling[0]] = ids[token]
        # (left id, right id) -> (rank, id of the two joined)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.ranks = PairTable(self.merges)
        self.joinable = np.zeros((256, 256), dtype=bool)
        for spelling in spelled.values():
            for a, b in zip(spelling, spelling[1:]):
                self.joinable[a, b] = True
        self.spelled = Pool([*self.bytes_of])
        self.shown = Pool([b"%d," % i for i in range(size)])
        self.cut_added = (
            regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        )
        self.kinds = character_kinds()
        self.seen = Seen()

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The merges of one long fragment with a heap and a linked list, in n log n steps."""
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = joined, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: np.ndarray) -> np.ndarray:
        """The merges of many fragments at once, a row each, padded with ``PAD``.

        In every round each row joins its lowest-ranked pair, the leftmost if
        it occurs more than once; rows without a pair are finished.
        """
        open_rows = np.arange(len(ids))
        columns = np.arange(ids.shape[1])
        work = ids
        while len(open_rows):
            at_pair = self.ranks.find(work[:, :-1], work[:, 1:])
            best = at_pair.argmin(axis=1)
            rank = at_pair[np.arange(len(work)), best]
            more = rank < NO_PAIR
            ids[open_rows[~more]] = work[~more]
            open_rows, work, best, rank = open_rows[more], work[more], best[more], rank[more]
            source = columns + (columns > best[:, None])
            padded = np.pad(work, ((0, 0), (0, 1)), constant_values=PAD)
            work = np.take_along_axis(padded, source, axis=1)
            work[np.arange(len(work)), best] = self.ranks.joined[rank]
        return ids

    def encode_words(self, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, end to end, and how many each has.

        ``values`` are their bytes, one pre-token between two ``edges``.
        """
        cut = np.ones(len(values), dtype=bool)
        cut[1:] = ~self.joinable[values[:-1], values[1:]]
        cut[edges[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(values)))
        first = self.single[values]
        # The ids of a fragment stand where its bytes stood, then -1.
        flat = np.full(len(values), -1, dtype=np.int64)
        shorter = 1
        flat[starts[lengths == 1]] = first[starts[lengths == 1]]
        for longest in (4, 8, 12, 20, LONG):
            chosen = (lengths > shorter) & (lengths <= longest)
            at, n = starts[chosen], lengths[chosen]
            shorter = longest
            if not len(at):
                continue
            columns = np.arange(longest)
            inside = columns < n[:, None]
            places = np.minimum(at[:, None] + columns, len(values) - 1)
            merged = self._merge_short(np.where(inside, first[places], PAD))
            kept = merged != PAD
            flat[places[kept]] = merged[kept]
        for at, n in zip(starts[lengths > LONG].tolist(), lengths[lengths > LONG].tolist()):
            ids = self._merge_long(first[at : at + n].tolist())
            flat[at : at + len(ids)] = ids
        kept = flat >= 0
        return flat[kept], np.add.reduceat(kept, edges[:-1], dtype=np.int64)

    def words(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of ``PATTERN`` start; ``edges`` are starts of separate texts.

        A run of one kind of character is a word. The last character of white
        space before another kind goes to that word if it is a plain blank, and
        is a word of its own if not. A contraction starts where a run of other
        characters starts with an apostrophe that no blank precedes.
        """
        n = len(points)
        kind = self.kinds[points]
        start = np.empty(n + 3, dtype=bool)
        start[0] = True
        start[1:n] = kind[1:] != kind[:-1]
        start[n:] = False
        text_start = np.zeros(n + 1, dtype=bool)
        text_start[edges] = True
        text_start[n] = True
        start[:n] |= text_start[:n]
        blank = np.flatnonzero((kind == SPACE)[:-1] & (kind != SPACE)[1:] & ~text_start[1:n]) if n > 1 else np.zeros(0, int)
        plain = points[blank] == 32
        start[blank] = True
        start[blank[plain] + 1] = False
        quote = np.flatnonzero((points == 39) & start[:n])
        ahead = np.append(points, (0, 0, 0))
        # Characters past the end of the own text belong to no contraction.
        limit = np.append(text_start, (True, True))
        one = np.where(limit[quote + 1], 0, ahead[quote + 1])
        two = np.where(limit[quote + 1] | limit[quote + 2], 0, ahead[quote + 2])
        short = np.isin(one, (115, 116, 109, 100))  # s, t, m, d
        long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))  # re, ve, ll
        for chosen, length in ((short, 2), (long, 3)):
            at = quote[chosen]
            start[at + 1] = False
            start[at + length] = True
        return np.flatnonzero(start[:n])

    def encode_buffer(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that lie end to end in ``data``, and how many each has."""
        counts = np.zeros(len(lengths), dtype=np.int64)
        if not data:
            return np.zeros(0, dtype=np.int64), counts
        text = data.decode()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(width, out=byte_at[1:])
        byte_edges = np.cumsum(np.append(0, lengths))
        edges = np.searchsorted(byte_at, byte_edges[:-1])
        special = [(m.start(), m.end(), self.added[m.group()]) for m in self.cut_added.finditer(text)] if self.cut_added else []
        inside = np.unique(edges[lengths > 0])
        if special:
            # Not across the border of two texts.
            bounds = np.append(inside, len(points))
            special = [x for x in special if bounds[np.searchsorted(bounds, x[0], side="right")] >= x[1]]
            inside = np.unique([*inside.tolist(), *(x[0] for x in special), *(x[1] for x in special if x[1] < len(points))])
        starts = self.words(points, inside.astype(np.int64))
        if special:
            skipped = np.zeros(len(points), dtype=bool)
            for a, b, _ in special:
                skipped[a + 1 : b] = True
            starts = starts[~skipped[starts]]
        ends = np.append(starts[1:], len(points))
        keys = span_hashes(points, starts, ends)
        values = np.frombuffer(data, dtype=np.uint8)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = self.seen.missing(unique)
        if len(new):
            chosen = first[new]
            spans, at = gathered(values, byte_at[starts[chosen]], byte_at[ends[chosen]])
            self.seen.add(unique[new], *self.encode_words(spans, at))
        ids, n = self.seen.look(unique, inverse)
        if special:
            override = dict((a, i) for a, _, i in special)
            hit = np.flatnonzero(np.isin(starts, list(override)))
            ids, n = replaced(ids, n, hit, np.array([override[x] for x in starts[hit].tolist()]))
        self.seen.forget(first, unique, ends - starts)
        at = np.cumsum(np.append(0, n))
        words_of = np.searchsorted(starts, np.append(edges, len(points)))
        counts = at[words_of[1:]] - at[words_of[:-1]]
        return ids, counts

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        encoded = [(t or "").encode() for t in texts]
        ids, counts = self.encode_buffer(b"".join(encoded), np.array([len(e) for e in encoded], dtype=np.int64))
        at = np.cumsum(np.append(0, counts)).tolist()
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(document: str) -> ByteBPE:
    """One vocabulary per Python worker, kept between tasks."""
    return ByteBPE(document)


def _shipped(df: DataFrame, path: str):
    """The vocabulary file's text, read once by the driver and broadcast.

    Its size is that of one file, a parameter; it does not grow with the data.
    """
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every text.

    Null and empty texts have no ids. Repeated rows come out as often as they
    went in; other columns are left out, so none can clash.
    """
    shipped = _shipped(df, path)

    def make():
        model = tokenizer(shipped.value)

        def run(batch):
            ids, counts = model.encode_buffer(*buffer_of(batch.column("text")))
            edges = pa.array(np.cumsum(np.append(0, counts)), pa.int32())
            lists = pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("key"), lists], names=[id_col, "ids"])

        return run

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return map_slices(rows, make, f"`{id_col}` {kind}, ids array<int>", chars=ENCODED_CHARS)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the ``text`` that ``ids_col`` spells; null ids spell an empty text.

    Bytes that are no UTF-8 become U+FFFD.
    """
    shipped = _shipped(df, path)

    def run(batches):
        model = tokenizer(shipped.value)
        for batch in batches:
            texts = [model.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(texts, pa.string())], names=[id_col, "text"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Digests of encoding every text and decoding its ids, in one pass over the texts.

    Columns: ``id_col``, ``n_tokens long``, ``ids_sha256`` of the decimal ids
    joined by commas, ``decoded_sha256`` of the decoded text in UTF-8; and, if
    asked for, ``ids array<int>``. A null text counts as empty. Other columns are
    left out.
    """
    shipped = _shipped(df, path)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def make():
        model = tokenizer(shipped.value)

        def run(batch):
            data, lengths = buffer_of(batch.column("text"))
            ids, counts = model.encode_buffer(data, lengths)
            shown, shown_at = model.shown.joined(ids, counts)
            spelled, at = model.spelled.joined(ids, counts)
            texts = [spelled[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]
            lists = [shown[a : max(a, b - 1)] for a, b in zip(shown_at, shown_at[1:])]
            columns = [
                batch.column("key"),
                pa.array(counts),
                pa.array(map(sha, lists), pa.string()),
                pa.array(map(sha, texts), pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, counts)), pa.int32()), pa.array(ids, pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        return run

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, make, schema + ", ids array<int>" * with_ids, chars=ENCODED_CHARS)
