"""Jaccard join of documents on sets of word shingles, exact, and its components.

Sets alike in all elements are one node. Nodes meet in tiles: for each band of
set sizes the hashes are dealt into more parts than two linked sets can differ
in elements, so two linked sets hold the same elements in at least one part, and
that part's elements name a tile. Parts that only hold shingles of many sets, as
of a line that many texts have, and the smallest parts would bring together sets that
are not alike. So sets are dealt into spare parts, and each leaves out as many parts, the most
common first: linked sets then agree in one more part than is left out, and rank the
parts they agree in alike. What meets in tiles of one band forms groups of candidates. Inside a group only bitmaps of hashed elements are compared: the bits
in which two bitmaps differ are at most the elements in which the sets differ, so
their count bounds the overlap from above. What these let pass forms much smaller
groups, whose sets are intersected exactly, as sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.components import components
from termeval.llm.shared import BROADCAST_IDS, ODD, buffer_of, map_slices, mixed, release, slices, words_of

WORDS, PERCENT = 4, 85
# Linked sets lie in one band or two neighbouring ones from this on.
LEAST_PERCENT = 67
# Signatures a task gathers before it combines and hands them on.
GATHERED = 600_000
# Nodes of a group compared in one task; larger groups are dealt into blocks.
BLOCK = 2_048
# Divisions a set is dealt by at most, each only if those before leave too many parts empty.
DIVISIONS = 8
# Spare parts for each element in which linked sets differ: one for so many.
APART_PER_SPARE = 2
# Buckets of tiles for each shuffle partition, at least, and shingles for each bucket, at most.
BUCKETS_PER_PARTITION = 2
SHINGLES_PER_BUCKET = 2_000_000
# Shingles a task gathers before it counts them, and how many of the sets gathered
# hold one that is told of.
COUNTED, TOLD = 600_000, 2
# Sets told of that make a shingle common, and the common shingles sent to tasks at most.
COMMON, MOST_COMMON = 16, 1_000_000


def linked(shared: int, one: int, other: int, percent: int) -> bool:
    return 100 * shared >= percent * (one + other - shared)


def most_apart(total: int, percent: int) -> int:
    """The elements in which two linked sets of ``total`` elements together differ at most."""
    shared = -(-percent * total // (100 + percent))
    return total - 2 * shared


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[list[int], list[int], list[int]]:
    """Least sizes of the bands up to ``largest``, parts of each, and spare parts of each."""
    least = [1]
    while least[-1] <= largest:
        least.append(max(least[-1] + 1, math.ceil(least[-1] * 1.5)))
    parts, spare = [], []
    for low, high in zip(least, [x - 1 for x in least[1:]] + [least[-1] * 2]):
        totals = range(2 * low, high + high * 100 // percent + 1)
        apart = max(most_apart(t, percent) for t in totals)
        spare.append(apart // APART_PER_SPARE)
        parts.append(apart + 1 + spare[-1])
    return least, parts, spare


def sets_of(data: bytes, lengths: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased."""
    hashes, at, _, _ = words_of(data, lengths)
    rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
    for i in range(1, words):
        rolled *= ODD
        rolled += hashes[i : len(hashes) - words + 1 + i]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(at, at[1:]):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * ODD + h
            found.append(mixed(np.array([whole])))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def node_of(own: np.ndarray) -> int:
    """One hash for a whole set."""
    with np.errstate(over="ignore"):
        total = mixed(own + ODD).sum(dtype=np.uint64) * ODD + np.uint64(len(own))
    return int(mixed(np.array([total])).view(np.int64)[0])


def bands_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of ``n`` meets others, with parts and spare parts: its own and,
    if it can link to smaller sets there, the one below."""
    least, parts, spare = bands(percent, 1 << max(6, n.bit_length()))
    band = int(np.searchsorted(least, n, side="right")) - 1
    below = band > 0 and -(-percent * n // 100) < least[band]
    return [(b, parts[b], spare[b]) for b in ((band, band - 1) if below else (band,)) if parts[b] > 1]


def places_of(node: int, n: int, percent: int) -> list[int]:
    """A node's names in the bands of ``bands_of``."""
    at = np.array([b + 1 for b, _, _ in bands_of(n, percent)], dtype=np.uint64)
    return mixed(np.uint64(node & (1 << 64) - 1) ^ mixed(at * ODD)).view(np.int64).tolist()


def bitmap_of(own: np.ndarray) -> np.ndarray:
    """The parity of the elements that fall on each bit; at least two bits an element."""
    width = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sets_holding(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In about how many sets each of ``own`` is, 0 if it is not ``common``."""
    shingles, sets = common
    if not len(shingles):
        return np.zeros(len(own), dtype=np.int64)
    place = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
    return np.where(shingles[place] == own, sets[place], 0)


def signatures(own: np.ndarray, percent: int, holding: np.ndarray) -> list[np.ndarray]:
    """The tiles of a set in each of its bands; ``holding`` tells in how many sets its elements are.

    As many parts as are spare are left out: those without elements first, then those whose
    rarest element is in most sets, then those of fewest elements. Of the parts in which two linked
    sets agree, more than are left out, both rank the same one last, so neither leaves it out.
    """
    all_found = []
    for b, m, spare in bands_of(len(own), percent):
        found = []
        numbers = np.arange(m, dtype=np.uint64) << np.uint64(16)
        for division in range(DIVISIONS):
            # Sets of one band and the next share this division of all hashes.
            seed = np.uint64(b + 1 + (division << 16))
            part = (mixed(own ^ seed) % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own[order] * ODD), dtype=np.uint64)])
            counts = np.bincount(part, minlength=m)
            ends = np.cumsum(counts)
            value = sums[ends] - sums[ends - counts]
            held = counts > 0
            rarest = np.full(m, np.iinfo(np.int64).max)
            rarest[held] = np.minimum.reduceat(holding[order], (ends - counts)[held])
            kept = np.lexsort((value, counts, -rarest))[spare:]
            # With so many empty parts two linked sets might agree in these alone. Then
            # both have them empty, so both go on to the next division.
            enough = m - np.count_nonzero(held) <= spare
            if enough or division < DIVISIONS - 1:
                kept = kept[held[kept]]
            found.append(mixed(value[kept] * ODD + mixed(numbers[kept] | seed << np.uint64(40))))
            if enough:
                break
        all_found.append(np.concatenate(found))
    return all_found


def nodes(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``node``, its ``places`` in bands and its ``bits``, of every text."""

    def make():
        def run(batch):
            found = sets_of(*buffer_of(batch.column("text")), words)
            names = [node_of(x) for x in found]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array([places_of(k, len(x), percent) if len(x) else [] for k, x in zip(names, found)], pa.list_(pa.int64())),
                    pa.array([bitmap_of(x).tobytes() if len(x) else None for x in found], pa.binary()),
                ],
                names=["key", "n_shingles", "node", "places", "bits"],
            )

        return run

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_slices(rows, make, f"key {kind}, n_shingles long, node long, places array<bigint>, bits binary")


def _first_of_each(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each signature the least node; and the pairs of it and each other node."""
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    first = np.concatenate([[True], signature[1:] != signature[:-1]]) if len(signature) else np.zeros(0, bool)
    least = node[first][np.cumsum(first) - 1] if len(signature) else node
    pairs = np.unique(np.column_stack([least, node])[least != node], axis=0).reshape(-1, 2)
    return signature[first], node[first], pairs[:, 0], pairs[:, 1]


def common_shingles(df: DataFrame, text_col: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many different sets hold, sorted, and in about how many each is.

    Tasks count all their shingles and tell of those that several sets in a row of sets hold.
    Which are told of only decides what parts ``signatures`` leaves out, not what links.
    """

    def count(batches):
        known: set[int] = set()
        held, size = [], 0

        def told():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            several = n >= TOLD
            columns = [pa.array(found[several].view(np.int64), pa.int64()), pa.array(n[several], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["shingle", "n"])

        for batch in slices(batches):
            for own in sets_of(*buffer_of(batch.column("text")), words):
                if not len(own) or (node := node_of(own)) in known:
                    continue
                known.add(node)
                held.append(own)
                size += len(own)
            if size > COUNTED:
                yield told()
                held, size = [], 0
                known.clear()
        if size:
            yield told()
        held.clear()
        release()

    told = df.select(F.col(text_col).alias("text")).mapInArrow(count, "shingle long, n long")
    sums = told.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    sums = materialise(sums.withColumn("power", F.floor(F.log2("n"))), "join-common")
    least, left = 0, MOST_COMMON
    for row in sums.groupBy("power").count().orderBy(F.desc("power")).collect():
        left -= row["count"]
        if left < 0:
            least = row["power"] + 1
            break
    rows = sums.where(F.col("power") >= least).select("shingle", "n").toArrow()
    shingles = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("n").to_numpy()[order]


def candidates(
    df: DataFrame, text_col: str, words: int = WORDS, percent: int = PERCENT, shingles: int = 0
) -> DataFrame:
    """Pairs ``a``, ``b`` of places that chain together all nodes that meet in tiles of one band.

    Tasks combine what they have gathered first: one node of each tile goes on,
    with pairs for the others, so a tile never holds more rows than tasks wrote.
    ``shingles`` is how many all nodes have; more of them take more buckets of tiles.
    """
    spark = df.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(buckets, -(-shingles // SHINGLES_PER_BUCKET))
    shipped = spark.sparkContext.broadcast(common_shingles(df, text_col, words))

    def packed(bucket: int, one: np.ndarray, other: np.ndarray):
        place = (one % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        one, other, place = one[order], other[order], place[order]
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
        stops = np.append(edges[1:], len(place))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(place[edges].astype(np.int32) * 2 + bucket, pa.int32()),
                pa.array([one[a:b].tobytes() for a, b in zip(edges, stops)], pa.binary()),
                pa.array([other[a:b].tobytes() for a, b in zip(edges, stops)], pa.binary()),
            ],
            names=["bucket", "one", "other"],
        )

    def gather(batches):
        common = shipped.value
        known: set[int] = set()
        held, size = [], 0

        def combined():
            signature, node, a, b = _first_of_each(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            yield from packed(0, signature, node)
            if len(a):
                yield from packed(1, a.view(np.uint64), b.view(np.uint64))

        for batch in slices(batches):
            for own in sets_of(*buffer_of(batch.column("text")), words):
                if not len(own) or (node := node_of(own)) in known:
                    continue
                known.add(node)
                for found, place in zip(signatures(own, percent, sets_holding(own, common)), places_of(node, len(own), percent)):
                    held.append((found, np.full(len(found), place, dtype=np.int64)))
                    size += len(found)
            if size > GATHERED:
                yield from combined()
                held, size = [], 0
                known.clear()
        if size:
            yield from combined()
        held.clear()
        release()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = [], []
        for batch in batches:
            one += [np.frombuffer(x, dtype=np.uint64) for x in batch.column("one").to_pylist()]
            other += [np.frombuffer(x, dtype=np.int64) for x in batch.column("other").to_pylist()]
        one, other = np.concatenate(one), np.concatenate(other)
        if key[0].as_py() % 2:
            pairs = np.unique(np.column_stack([one.view(np.int64), other]), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        else:
            _, _, a, b = _first_of_each(one, other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    packs = df.select(F.col(text_col).alias("text")).mapInArrow(gather, "bucket int, one binary, other binary")
    return packs.groupBy("bucket").applyInArrow(meet, "a long, b long")


class Compared:
    """Sets that are compared with each other: bitmaps first, then the sorted arrays if there are any."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None, percent: int):
        self.sizes, self.sets, self.percent = sizes, sets, percent
        self.width = np.array([len(x) for x in bitmaps], dtype=np.int64)
        self.place = np.zeros(len(bitmaps), dtype=np.int64)
        self.of_width = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            self.of_width[width] = np.stack([bitmaps[i] for i in at.tolist()])

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """The bits in which ``i`` and each of ``others`` differ; wider bitmaps are folded."""
        found = np.zeros(len(others), dtype=np.int64)
        own, widths = self.of_width[int(self.width[i])][self.place[i]][None], self.width[others]
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            one, other = own, self.of_width[width][self.place[others[at]]]
            while one.shape[1] > other.shape[1]:
                one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
            while other.shape[1] > one.shape[1]:
                other = other[:, : other.shape[1] // 2] ^ other[:, other.shape[1] // 2 :]
            found[at] = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
        return found

    def links(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with ``i`` or, without sets, may do so."""
        sizes = self.sizes[others]
        others = others[100 * np.minimum(sizes, self.sizes[i]) >= self.percent * np.maximum(sizes, self.sizes[i])]
        both = self.sizes[others] + self.sizes[i]
        bound = (both - self.apart(i, others)) // 2
        others = others[100 * bound >= self.percent * (both - bound)]
        if self.sets is None:
            return others
        own, found = self.sets[i], []
        for j in others.tolist():
            other = self.sets[j]
            place = np.minimum(np.searchsorted(own, other), len(own) - 1)
            if linked(int(np.count_nonzero(own[place] == other)), len(own), len(other), self.percent):
                found.append(j)
        return np.array(found, dtype=np.int64)


def _spread(compared: Compared, n: int) -> list[tuple[int, int]]:
    """Links that connect all connected ones among the first ``n`` sets."""
    left, found = np.arange(n), []
    while len(left):
        seed, left = int(left[0]), left[1:]
        queue = [seed]
        while queue and len(left):
            i = queue.pop()
            near = compared.links(i, left)
            found += [(i, j) for j in near.tolist()]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return found


def links(
    df: DataFrame, of_node: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Exact links ``a``, ``b`` that connect every two nodes connected by links.

    ``of_node`` has one row of ``nodes`` for each node.
    """
    shingles = of_node.agg(F.sum("n_shingles")).first()[0] or 0
    met = components(candidates(df, text_col, words, percent, shingles)).select(F.col("node").alias("place"), F.col("component").alias("group"))
    placed = of_node.select("node", F.explode("places").alias("place")).join(met, "place").select("node", "group")

    def with_bits(members: DataFrame) -> DataFrame:
        return members.join(of_node.select("node", "n_shingles", F.col("bits").alias("held")), "node")

    likely = components(_connecting(placed, with_bits, percent, exact=False))
    near = likely.select("node", F.col("component").alias("group")).join(of_node.select("node", "key"), "node")
    near = materialise(near, "join-near")
    keys = near.select("key", "node")

    def make():
        def run(batch):
            out = [[] for _ in range(6)]
            for own, places in zip(sets_of(*buffer_of(batch.column("text")), words), batch.column("places").to_pylist()):
                shown, node = own.tobytes(), node_of(own)
                for place in places:
                    # Of texts that share an id only those of the node.
                    if place["node"] == node:
                        values = (node, place["group"], place["block"], place["extra"], len(own), shown)
                        for column, value in zip(out, values):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            names = ["node", "group", "block", "extra", "n_shingles", "held"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        return run

    def with_sets(members: DataFrame) -> DataFrame:
        place = F.struct("node", "group", "block", "extra")
        ids = members.join(keys, "node").groupBy("key").agg(F.collect_list(place).alias("places"))
        few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        # A null id may stand for a node too.
        ids = ids.withColumnRenamed("key", "node_key")
        same = F.col("key").eqNullSafe(F.col("node_key"))
        rows = texts.join(F.broadcast(ids) if few else ids, same).select("text", "places")
        return map_slices(rows, make, "node long, group long, block int, extra boolean, n_shingles long, held binary")

    return _connecting(near.select("node", "group"), with_sets, percent, exact=True)


def _connecting(
    groups: DataFrame, with_held: Callable[[DataFrame], DataFrame], percent: int, exact: bool
) -> DataFrame:
    """Links ``a``, ``b`` that connect every two nodes of a ``group`` connected by links in it.

    ``with_held`` adds ``n_shingles`` and ``held``, the set or, unless ``exact``,
    its bitmap. Groups over ``BLOCK`` nodes are dealt into blocks. Then the first
    node of each part of a block meets all blocks, and last every node outside
    the group's largest part does, so that no link between different parts is lost.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = groups.join(sizes, "group").select(
        "node", "group", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")
    )
    chosen = materialise(dealt, "join-members")

    def compare(members: DataFrame) -> DataFrame:
        def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            node = rows.column("node").to_numpy()
            extra = rows.column("extra").to_numpy(zero_copy_only=False).astype(bool)
            _, first = np.unique(np.column_stack([node, extra]), axis=0, return_index=True)
            first = first[np.argsort(extra[first], kind="stable")]
            node, extra, sizes = node[first], extra[first], rows.column("n_shingles").to_numpy()[first]
            column = rows.column("held")
            held = [np.frombuffer(column[int(i)].as_py(), dtype=np.uint64) for i in first]
            bitmaps = [bitmap_of(x) for x in held] if exact else held
            compared, n = Compared(sizes, bitmaps, held if exact else None, percent), int(np.count_nonzero(~extra))
            if extra.any():
                own = np.arange(n)
                found = [(i, j) for i in range(n, len(held)) for j in compared.links(i, own).tolist()]
            else:
                found = _spread(compared, n)
            pairs = node[np.array(found, dtype=np.int64).reshape(-1, 2)]
            return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

        rows = with_held(members.select("node", "group", "block", "extra"))
        return rows.groupBy("group", "block").applyInArrow(run, "a long, b long").where("a != b")

    found = materialise(compare(chosen.withColumn("extra", F.lit(False))), "join-links")
    split = chosen.where("blocks > 1")
    if split.isEmpty():
        return found

    def joined(parts: DataFrame, outside: DataFrame) -> DataFrame:
        """Compare ``outside`` with all blocks of its groups."""
        everywhere = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["node", "group", "block"]
        members = split.select(*columns, F.lit(False).alias("extra")).unionByName(
            everywhere.select(*columns, F.lit(True).alias("extra"))
        )
        return parts.unionByName(materialise(compare(members), "join-links"))

    def parts_of(links_: DataFrame) -> DataFrame:
        known = components(links_)
        return split.join(known, "node", "left").withColumn("part", F.coalesce("component", "node"))

    firsts = parts_of(found).groupBy("group", "block", "part").agg(F.min_by(F.struct("node", "blocks"), "node").alias("x"))
    found = joined(found, firsts.select("group", "x.*"))
    parted = materialise(parts_of(found), "join-parts")
    by_size = parted.groupBy("group", "part").agg(F.count("*").alias("n"))
    largest = by_size.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    outside = parted.join(largest, ["group", "part"], "left_anti")
    return found if outside.isEmpty() else joined(found, outside)


def join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``id_col``, ``n_shingles long``, ``component_id`` of every document.

    ``component_id`` is the least id reachable by links, the own included. Null
    and empty texts, and texts of blanks, have no shingles and link with nothing.
    Texts with fewer words than a shingle have all of them as one. Repeated ids
    and null ids are kept; a null id is greater than any other. Other columns are
    left out. ``percent`` is at least ``LEAST_PERCENT``.
    """
    if not LEAST_PERCENT <= percent <= 100 or words < 1:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100, and words 1 at least")
    rows = materialise(nodes(df, id_col, text_col, words, percent), "join-nodes")
    filled = rows.where("n_shingles > 0")
    of_node = filled.groupBy("node").agg(
        F.min("key").alias("key"), *(F.any_value(c).alias(c) for c in ("n_shingles", "places", "bits"))
    )
    of_node = materialise(of_node, "join-nodes")
    found = components(links(df, of_node, id_col, text_col, words, percent))
    least = of_node.join(found, "node").groupBy("component").agg(F.min("key").alias("joined"))
    of_linked = found.join(least, "component").select("node", "joined")
    ids = of_node.join(of_linked, "node", "left").select("node", F.coalesce("joined", "key").alias("component_id"))
    known = filled.join(ids, "node", "left").select("key", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return known.unionByName(alone).withColumnRenamed("key", id_col)
