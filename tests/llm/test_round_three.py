"""Substring dedup, lexical search and spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termeval.llm import lexical_search, spelling, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "one"), (5, LONG), (6, "漢字 and ́ 😀"), (7, "one"), (7, "one"), (None, "no id"), (8, LONG)]
CLASHES = ("doc", "name", "id", "word", "n", "item", "score", "rank", "gone", "terms", "kept")


def frame(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASHES))


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Substring dedup


def deduplicated(rows, window):
    """Brute force: all windows of all documents in one dictionary."""
    last = 2**63 - 1
    split = [(last if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for key, _, words in split:
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            least[own] = min(least.get(own, last), key)
    found = []
    for key, doc, words in split:
        left = [True] * len(words)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < key:
                left[i : i + window] = [False] * window
        found.append((doc, len(words), left.count(False), b" ".join(w for w, x in zip(words, left) if x).decode()))
    return sorted(found, key=repr)


def some_texts(seed, n=150):
    rng = random.Random(seed)

    def text():
        if rng.random() < 0.1:
            return rng.choice([None, "", " \n "])
        return "".join(rng.choice(["a", "b", "A", "é"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(60)))

    rows = [(rng.choice([None, *range(1, 40)]), text()) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = some_texts(seed)
    df = frame(spark, rows).repartition(5)
    assert tuples(substring_dedup.remove(df, window=6, seed=2)) == deduplicated(rows, 6)


def test_substring_dedup_of_odd_rows(spark):
    assert tuples(substring_dedup.remove(frame(spark, ODD))) == deduplicated(ODD, 50)
    assert tuples(substring_dedup.remove(frame(spark, []))) == []


def test_a_bucket_meets_its_strings_piece_by_piece():
    """What is left of one piece meets the next; the order of pieces does not matter."""
    rows = [(d, " ".join(random.Random(d % 3).choices("abcdef", k=40))) for d in range(12)]
    rng = random.Random(4)
    for _ in range(5):
        rng.shuffle(rows)
        held, gone = [], set()
        for d, text in rows:
            data = text.encode()
            one = np.array([d]), np.array([d]), np.zeros(1, dtype=np.int64)
            held.append(substring_dedup.Strings(data, np.array([len(data)]), *one))
            runs, left, _ = substring_dedup.met(substring_dedup._joined(held), 8, 2)
            gone |= {(int(a), i) for a, _, b, c in zip(*runs) for i in range(b, c)}
            held = [left]
        expected = {(d, i) for d in range(3, 12) for i in range(40)}
        assert gone == expected


def test_windows_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(substring_dedup, "span_hashes", lambda points, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    texts = ["a b c d", "a b c e", "x a b c", "a b c d"]
    data = "".join(texts).encode()
    strings = substring_dedup.Strings(data, np.array([7] * 4), np.arange(4), np.arange(4), np.zeros(4, dtype=np.int64))
    runs, _, _ = substring_dedup.met(strings, 3, 1)
    assert sorted(zip(runs.docs.tolist(), runs.firsts.tolist(), runs.ends.tolist())) == [(1, 0, 3), (2, 1, 4), (3, 0, 4)]


# Ranked lexical search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def searched(rows, items, top=10):
    """Brute force: every item against every document."""
    counts = [(d, Counter(terms_of(t))) for d, t in rows]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(terms_of(text))
    found = []
    for item, terms in by_item.items():
        scored = []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in counts) + 1))) for t in terms}
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // length
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort()
        found += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(scored[:top])]
    return sorted(found, key=repr)


ITEMS = [(1, "b c É d"), (2, None), (3, ""), (4, "c1 B"), (None, "a b"), (4, "e"), (5, "漢字 one")]


def test_lexical_search_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-5, 60)]), " ".join(rng.choices(["a", "B", "c", "d", "É", "e-c1", "f"], k=rng.randrange(9)))) for _ in range(150)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical_search.search(frame(spark, rows).repartition(4), items, top=3)
    assert tuples(found) == searched(rows, ITEMS, 3)


def test_lexical_search_of_odd_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert tuples(lexical_search.search(frame(spark, ODD), items)) == searched(ODD, ITEMS)
    assert tuples(lexical_search.search(frame(spark, []), items)) == []
    assert tuples(lexical_search.search(frame(spark, ODD), items.limit(0))) == []


def test_equal_scores_rank_by_id_across_tasks(spark):
    rows = [(i, "same text") for i in range(99, -1, -1)] + [(i, "other") for i in range(200, 220)]
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    found = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), items)
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(i + 1, i) for i in range(10)]


def test_items_of_several_passes_tiles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PASS_BYTES", 400)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"t{k}" for k in range(40)], k=30))) for i in range(80)]
    items = [(i, " ".join(f"t{k}" for k in rng.sample(range(50), 12))) for i in range(20)]
    found = lexical_search.search(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert tuples(found) == searched(rows, items)


def test_no_sum_of_a_part_leaves_the_exact_numbers():
    weights = np.full(3_000, 2**53 // lexical_search.IMPACT // 10, dtype=np.int64)
    ((first, parts),) = lexical_search.tiles_of([np.arange(3_000)], weights)
    assert first == 0 and sum(len(terms) for terms, _ in parts) == 3_000
    assert all(int(matrix.sum()) * lexical_search.IMPACT <= lexical_search.EXACT for _, matrix in parts)


# Spelling variants


def grouped(rows):
    """Brute force: every edit of every word."""
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: x for w, x in counts.items() if x >= 5}
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in letters}
        found = [x for x in edits - {w} if x in n]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w], near[w] = best if best and n[best] >= 5 * n[w] else None, len(found)

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n), key=repr)


def variant_texts(seed):
    rng = random.Random(seed)
    base = ["banana", "aaaaaaa", "letters", "élèves", "straße", "abcabcab"]

    def word():
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 and "ß" not in w else w

    return [(rng.choice([None, *range(300)]), rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(60)))) for _ in range(200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, monkeypatch, seed):
    # Small groups, so that nodes lie across bounds.
    monkeypatch.setattr(spelling, "GROUP_WORDS", 20)
    rows = variant_texts(seed)
    expected = grouped(rows)
    assert len(expected) > 100 and any(x[1] for x in expected)
    assert tuples(spelling.variants(frame(spark, rows).repartition(3))) == expected


def test_variants_of_odd_rows(spark):
    rows = ODD + [(9, "x" * 20_000)] * 5 + [(9, "x" * 19_999)] * 30 + [(10, None)]
    assert tuples(spelling.variants(frame(spark, rows))) == grouped(rows)
    assert tuples(spelling.variants(frame(spark, []))) == []


def test_roots_follow_chains_to_their_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "id long, root long")
    assert tuples(spelling.roots(links)) == sorted([(i, 20) for i in range(20)] + [(50, 51)], key=repr)
