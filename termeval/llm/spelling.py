"""Variants of words by a dictionary of trie node pairs.

Every prefix of a word is a node of the trie of all words, every suffix one of the trie of the
reversed words; nodes are numbered. A word without its letter at a place is the pair of the nodes
before and after that place, and so is a word with a gap between two letters. Words that meet at
a pair with one letter skipped differ by a replaced letter; one with a letter skipped and one
with a gap differ by an inserted or deleted letter. Pairs are integers with the depths of their
nodes, so equal pairs mean equal letters: neighbours are exact, without a comparison of words.

At a pair at most one word has the gap and as many skip a letter as there are letters, so
groups are small. No pairs of words are made: each member takes from its group how many
others there are and the most frequent of them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.shared import buffer_of, slices

# Fixed values of the contract: least code points and occurrences of a word, and how many
# times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
# Of all runs of a document one in so many loses a letter.
ALTERED = 199
# Different words a task counts before it hands them on.
GATHERED = 200_000
# Words numbered in one task.
GROUP_WORDS = 50_000
# Words drawn for each bound between such groups.
DRAWN = 16


def _runs(data: bytes, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, each one's text and code points."""
    values = np.frombuffer(data.lower(), dtype=np.uint8)
    # In UTF-8 these are the byte C3 and the one after it.
    full = ((values >= 97) & (values <= 122)) | (values == 0xC3)
    full[1:] |= values[:-1] == 0xC3
    edges = np.cumsum(np.append(0, lengths))
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    first, last = edges[:-1][lengths > 0], edges[1:][lengths > 0] - 1
    begins[first], ends[last] = full[first], full[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    points = np.concatenate([[0], np.cumsum((values & 0xC0) != 0x80)])
    offsets = np.cumsum(np.append(0, stops - starts)).astype(np.int64)
    letters = pa.py_buffer(values[full].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters])
    return words, np.searchsorted(edges, starts, side="right") - 1, points[stops] - points[starts]


def altered(run: bytes, h: int) -> str:
    """The run, or the run without a letter if ``h`` says so."""
    word = run.decode()
    if h % ALTERED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word`` and ``n``: words of ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def shown(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        found: Counter = Counter()
        for batch in slices(batches):
            words, row, points = _runs(*buffer_of(batch.column("text")))
            long = points >= LEAST_LENGTH
            if not long.any():
                continue
            coded = words.filter(pa.array(long)).dictionary_encode()
            known, row = coded.dictionary.to_pylist(), row[long]
            # Runs of one document that are alike are altered alike.
            keys, counts = np.unique(row * len(known) + coded.indices.to_numpy(), return_counts=True)
            row, number = keys // len(known), keys % len(known)
            begun = [zlib.crc32(f"{x}:".encode()) for x in batch.column("id").to_pylist()]
            sums = np.array([zlib.crc32(known[k], begun[r]) for r, k in zip(row.tolist(), number.tolist())], dtype=np.int64)
            changed = sums % ALTERED == 0
            plain = np.bincount(number[~changed], counts[~changed], len(known)).astype(np.int64)
            for k in np.flatnonzero(plain).tolist():
                found[known[k].decode()] += int(plain[k])
            for k, h, n in zip(number[changed].tolist(), sums[changed].tolist(), counts[changed].tolist()):
                word = altered(known[k], h)
                if len(word) >= LEAST_LENGTH:
                    found[word] += n
            if len(found) >= GATHERED:
                yield shown(found)
                found = Counter()
        if found:
            yield shown(found)

    total = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= LEAST_COUNT)


def shared_letters(one: str, other: str) -> int:
    """The letters that both begin with."""
    n = min(len(one), len(other))
    for i in range(n):
        if one[i] != other[i]:
            return i
    return n


def nodes_of(words: list[tuple[str, int]], bounds: list[str]) -> Iterator[list[int]]:
    """The nodes of all prefixes, from none to all letters, of sorted words with their ids.

    The words are all those from one of the sorted ``bounds`` to the next. A node
    below which a bound lies may have words in other groups too: its number is that
    of its first bound, below 0. Any other node has words here only: its number is
    its first word's id.
    """
    before, known = "", []
    for word, own in words:
        after = bisect_right(bounds, word)
        outer = max([shared_letters(word, x) for x in bounds[max(0, after - 1) : after + 1]], default=-1)
        inner = shared_letters(word, before) if known else -1
        found = [-1 - bisect_left(bounds, word[:i]) for i in range(outer + 1)]
        found += known[len(found) : inner + 1]
        found += [own] * (len(word) + 1 - len(found))
        yield found
        before, known = word, found


def numbered(words: DataFrame, path: str, total: int) -> DataFrame:
    """``id`` and ``nodes array<long>``, those of all prefixes of the column ``path``.

    ``words`` has an ``id`` of 0 or more for each of the ``total`` different
    paths. Groups of about ``GROUP_WORDS`` neighbours in sorted order are numbered
    at once, between bounds taken from words drawn by hash: of their number there
    are about ``DRAWN`` for each group, so the driver holds no more.
    """
    groups = total // GROUP_WORDS + 1
    drawn = []
    if groups > 1:
        share = max(1, total // (groups * DRAWN))
        drawn = sorted(r[0] for r in words.where(F.pmod(F.xxhash64(path), F.lit(share)) == 0).select(path).collect())
    bounds = drawn[DRAWN - 1 :: DRAWN]
    shipped = words.sparkSession.sparkContext.broadcast(bounds)

    def placed(batches):
        for batch in batches:
            found = [bisect_right(shipped.value, x) for x in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], names=["part", "id", "path"])

    def number(rows: pa.Table) -> pa.Table:
        own = sorted(zip(rows.column("path").to_pylist(), rows.column("id").to_pylist()))
        nodes = [pa.array(x, pa.int64()) for x in nodes_of(own, shipped.value)]
        sizes = np.cumsum([0, *(len(x) for x in nodes)]).astype(np.int32)
        values = pa.concat_arrays(nodes)
        return pa.table({"id": pa.array([x[1] for x in own], pa.int64()), "nodes": pa.ListArray.from_arrays(pa.array(sizes), values)})

    dealt = words.select("id", F.col(path).alias("path")).mapInArrow(placed, "part int, id long, path string")
    return dealt.groupBy("part").applyInArrow(number, "id long, nodes array<bigint>")


def pairs(words: DataFrame) -> DataFrame:
    """``before``, ``prefix``, ``after``, ``suffix``: the pairs of nodes of each word, and whose they are.

    ``words`` has ``id``, ``n``, ``word``, ``prefixes`` and ``suffixes``. ``skip``
    tells words without a letter from those with a gap. Only the first of equal
    letters that follow each other is ``first``: without any of them the word is the same.
    """
    kinds = "before int, prefix long, after int, suffix long, negative long, id long, skip boolean, first boolean"

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "n", "word")]
            ahead, behind = batch.column("prefixes"), batch.column("suffixes")
            held, size = [], 0
            for row, (own, n, word) in enumerate(zip(*columns)):
                length = len(word)
                prefix, suffix = (x[row].values.to_numpy() for x in (ahead, behind))
                letters = np.array([ord(x) for x in word], dtype=np.int32)
                gaps, skips = np.arange(length + 1), np.arange(length)
                first = np.concatenate([[True], letters[1:] != letters[:-1]])
                before = np.concatenate([skips, gaps])
                after = np.concatenate([length - 1 - skips, length - gaps])
                skip = before + after < length
                held.append(
                    (before, prefix[before], after, suffix[after], np.full(len(before), -n), np.full(len(before), own), skip,
                     np.concatenate([first, np.zeros(length + 1, dtype=bool)]))
                )
                size += len(before)
                if size >= GATHERED:
                    yield _rows(held, kinds)
                    held, size = [], 0
            if held:
                yield _rows(held, kinds)

    return words.select("id", "n", "word", "prefixes", "suffixes").mapInArrow(run, kinds)


def _rows(held: list[tuple[np.ndarray, ...]], kinds: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x), types[kind]) for x, (_, kind) in zip(zip(*held), fields)], names=[x for x, _ in fields]
    )


def neighbours(met: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best``, the most frequent neighbour as (-n, id), of the words that have one."""
    member = F.struct("negative", "id", "skip", "first")
    groups = met.groupBy("before", "prefix", "after", "suffix").agg(F.sort_array(F.collect_list(member)).alias("members"))
    groups = groups.where(F.size("members") > 1)

    def named(x):
        return F.struct(x["negative"].alias("negative"), x["id"].alias("id"))

    skips = F.filter("members", lambda x: x["skip"])
    groups = groups.select(
        "members",
        F.transform(skips, named).alias("skips"),
        F.transform(F.filter(skips, lambda x: x["first"]), named).alias("firsts"),
        F.transform(F.filter("members", lambda x: ~x["skip"]), named).alias("gaps"),
    )

    def seen(x):
        """How many neighbours a member has in its group, and the best of them."""
        replaced = F.get("skips", F.when(F.get("skips", F.lit(0))["id"] == x["id"], F.lit(1)).otherwise(F.lit(0)))
        gap = F.when(x["first"], F.get("gaps", F.lit(0)))
        near = F.when(x["skip"], F.size("skips") - 1 + F.when(x["first"], F.size("gaps")).otherwise(0)).otherwise(F.size("firsts"))
        best = F.when(x["skip"], F.least(replaced, gap)).otherwise(F.get("firsts", F.lit(0)))
        return F.struct(x["id"].alias("id"), near.cast("long").alias("near"), best.alias("best"))

    each = groups.select(F.explode(F.transform("members", seen)).alias("x")).select("x.*").where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``id`` and ``root``: where the links from ``id`` to ``root`` end that begin at each id.

    Each round doubles the links that a row spans. ``n`` grows along a link by a
    factor, so there are few rounds.
    """
    links = materialise(links.select("id", "root"), "spelling-links")
    while True:
        following = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if links.join(following, "root", "left_semi").isEmpty():
            return links
        links = links.join(following, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        links = materialise(links, "spelling-links")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``form``, ``root`` string, ``n``, ``n_near``, ``form_n`` long of the frequent words of all texts.

    Runs are those of ``[A-Za-z`` and U+00C0 to U+00FF``]``, A-Z lower-cased; one in
    ``ALTERED``, by the crc32 of ``id:run``, loses a letter. Words have at least
    ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences, ``n``. Words are
    near that differ by one inserted, deleted or replaced code point; ``n_near``
    counts them. ``form`` is the near word of the greatest ``n`` (ties: the first
    by code points) if that, ``form_n``, is at least ``TIMES`` as great, else
    null. ``root`` is where forms lead to. Null and empty texts have no words; a
    missing id is an empty one; repeated rows count each time; other columns are
    left out.
    """
    plain = materialise(counted(df, id_col, text_col), "spelling-counts")
    # Ids in the order of code points.
    words = materialise(plain.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    total = words.count()
    ahead = numbered(words, "word", total).withColumnRenamed("nodes", "prefixes")
    behind = numbered(words.withColumn("back", F.reverse("word")), "back", total).withColumnRenamed("nodes", "suffixes")
    near = neighbours(pairs(words.join(ahead, "id").join(behind, "id")))
    known = words.join(near, "id", "left")
    form = F.when(-F.col("best.negative") >= TIMES * F.col("n"), F.col("best"))
    known = known.withColumn("best", form).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.id").alias("form_id"), (-F.col("best.negative")).alias("form_n")
    )
    known = materialise(known, "spelling-near")
    ends = roots(known.where("form_id is not null").select("id", F.col("form_id").alias("root")))

    def named(name: str) -> DataFrame:
        return words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))

    found = known.join(ends.withColumnRenamed("root", "root_id"), "id", "left")
    found = found.join(named("form"), "form_id", "left").join(named("root"), "root_id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
