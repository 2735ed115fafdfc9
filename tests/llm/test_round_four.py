"""Candidates of the shingle join: what shares a common line is not brought together, what links is."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline

from termeval.llm import shingle_join
from termeval.llm.components import components

LINE = "all rights are kept by the owner of this page and its text"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_texts_that_share_only_a_line_are_not_compared(spark, words, percent):
    rng = random.Random(words)
    rows = [(i, f"{LINE}\n" + " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(80, 160)))) for i in range(1000)]
    copies = [(10_000 + i, f"{t} more") for i, t in rows[::10]]
    df = frame(spark, rows + copies).repartition(2)
    groups = components(shingle_join.candidates(df, "text", words, percent))
    sizes = [r["count"] for r in groups.groupBy("component").count().collect()]
    # A copy meets its text in one or two bands, and hardly anything else.
    assert max(sizes) <= 6
    found = {r.doc_id: r.component_id for r in shingle_join.join(df, words=words, percent=percent).collect()}
    assert found == {**{i: i for i, _ in rows}, **{i: i - 10_000 for i, _ in copies}}


@pytest.mark.parametrize("percent", [67, 80, 85, 95])
def test_linked_sets_share_a_tile_whatever_is_common(percent):
    rng = np.random.default_rng(percent)

    def some(n):
        return rng.integers(0, 1 << 63, n, dtype=np.uint64)

    for n in [2, 3, 5, 8, 12, 20, 33, 50, 75, 113, 170, 255, 600] * 6:
        # As far apart as linked sets can be, by elements of either or of one alone.
        apart = max(k for k in range(n) if shingle_join.linked(n - k, n, n, percent))
        one_more = max(k for k in range(n) if shingle_join.linked(n - k, n, n - k, percent))
        both = some(n)
        pairs = [
            (both, np.concatenate([both[apart:], some(apart)])),
            (both, both[one_more:]),
        ]
        # Common are: none, all, those of both sets, half of them, and those of one set alone.
        tables = [both[:0], both, both[apart:], both[rng.random(n) < 0.5], both[:apart]]
        for a, b in pairs:
            for shingles in tables:
                common = (np.sort(shingles), rng.integers(16, 99, len(shingles)))
                own = [np.sort(x) for x in (a, b)]
                if np.array_equal(*own):
                    continue
                tiles = [
                    np.concatenate(shingle_join.signatures(x, percent, shingle_join.sets_holding(x, common))) for x in own
                ]
                assert len(np.intersect1d(*tiles))


def test_common_shingles_are_those_of_many_different_sets(spark, monkeypatch):
    rows = [(i, f"{LINE} w{i}") for i in range(40)]
    same = [(100 + i, "a text that stands here again and again") for i in range(40)]
    alone = [(200 + i, f"x{i} y{i} z{i} v{i} u{i}") for i in range(40)]
    df = frame(spark, rows + same + alone).coalesce(1)
    shingles, sets = shingle_join.common_shingles(df, "text", 4)
    line = shingle_join.sets_of(LINE.encode(), np.array([len(LINE)]), 4)[0]
    assert set(shingles.tolist()) == set(line.tolist()) and set(sets.tolist()) == {40}
    assert np.array_equal(shingles, np.sort(shingles))
    # The most frequent are kept where there are too many.
    monkeypatch.setattr(shingle_join, "MOST_COMMON", 4)
    assert not len(shingle_join.common_shingles(df, "text", 4)[0])
    monkeypatch.setattr(shingle_join, "MOST_COMMON", len(line))
    assert len(shingle_join.common_shingles(df, "text", 4)[0]) == len(line)


def test_near_copies_of_the_pipeline_do_not_meet_by_a_line(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, f"{LINE}\n" + " ".join(f"v{rng.randrange(10**9)}" for _ in range(100))) for i in range(600)]
    compared = []
    connecting = shingle_join._connecting

    def counted(groups, *others, **more):
        compared.append(groups.count())
        return connecting(groups, *others, **more)

    monkeypatch.setattr(shingle_join, "_connecting", counted)
    df = frame(spark, rows + [(1000, rows[5][1] + " more"), (1001, rows[5][1] + " more")]).repartition(2)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {i for i, _ in rows}
    assert max(compared) <= 30
