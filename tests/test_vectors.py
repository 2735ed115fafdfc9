import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from termeval.operators import vector_blocks, vector_grid, vectors
from termeval.sources.vocabulary import Vocabulary


def brute_force(queries, items, n):
    """[(query, rank, id)] in plain Python; NaN distances come last."""

    def distance(a, b):
        scale = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 1 - sum(x * y for x, y in zip(a, b)) / scale if scale else math.inf

    found = []
    for q, vector in queries:
        ranked = sorted((round(distance(vector, v), 9), i) for i, v in items)
        found += [(q, rank, i) for rank, (_, i) in enumerate(ranked[:n], 1)]
    return sorted(found)


def made(seed, size, copies=0, dim=4):
    draw = random.Random(seed)
    items = [(i, [draw.gauss(0, 1) for _ in range(dim)]) for i in range(size)]
    items += [(size + i, items[0][1]) for i in range(copies)]
    return items + [(size + copies, [0.0] * dim)]


def frames(spark, queries, items):
    return (
        spark.createDataFrame(queries, "query_id bigint, vector array<double>"),
        spark.createDataFrame(items, "concept_id bigint, embedding array<double>").repartition(3),
    )


def test_nearest_concepts(vocab):
    found = vectors.nearest_concepts([1.0, 0.0, 0.0], vocab, 3).collect()
    assert [(r.concept_id, r.content) for r in found] == [
        (1, "Acetaminophen"),
        (4, "Acetaminophen and Codeine Pill"),
        (3, "Acetaminophen Oral Tablet"),
    ]
    assert found[0].score == 0.0
    assert found[2].score == pytest.approx(1 - 0.9 / math.sqrt(0.82), abs=1e-6)


def test_batch_equals_single_queries(spark, vocab, rows):
    asked = [("x", [1.0, 0.0, 0.0]), ("y", [0.1, 1.0, 0.0]), ("z", [0.0, 0.2, 1.0])]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>")
    batch = vectors.nearest_concepts_batch(queries, vocab, 3).collect()
    for name, vector in asked:
        single = vectors.nearest_concepts(vector, vocab, 3).collect()
        ours = sorted((r for r in batch if r.query_id == name), key=lambda r: r.rank)
        assert [(r.concept_id, r.content) for r in ours] == [(r.concept_id, r.content) for r in single]
        assert [r.score for r in ours] == pytest.approx([r.score for r in single], abs=1e-7)


def test_vectors_without_a_concept_are_left_out(spark, vocab):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<float>")
    found = vectors.nearest_concepts_batch(queries, vocab, 10)
    assert 99 not in [r.concept_id for r in found.collect()]
    assert found.count() == 5


def test_smaller_k_is_a_prefix(spark):
    queries, items = frames(spark, made(1, 20), made(2, 50))
    five = {tuple(r)[:3] for r in vectors.nearest_vectors(queries, items, 5).collect()}
    twenty = vectors.nearest_vectors(queries, items, 20).filter("rank <= 5")
    assert five == {tuple(r)[:3] for r in twenty.collect()}


@pytest.mark.parametrize("n", [1, 3, 200])
def test_scan_equals_brute_force(spark, n):
    asked, items = made(3, 15), made(4, 60, copies=40)
    queries, frame = frames(spark, asked, items)
    found = vectors.nearest_vectors(queries, frame, n).select("query_id", "rank", "concept_id")
    assert sorted(map(tuple, found.collect())) == brute_force(asked, items, n)


@pytest.mark.parametrize("n, block_rows", [(3, 7), (1, 1000), (120, 16), (2, 9)])
def test_blocks_equal_brute_force(spark, n, block_rows):
    asked, items = made(5, 30, copies=15), made(6, 60, copies=40)
    queries, frame = frames(spark, asked, items)
    found = vector_grid.nearest_by_blocks(queries, frame, n, block_rows)
    found = found.select("query_id", "rank", "concept_id")
    assert sorted(map(tuple, found.collect())) == brute_force(asked, items, n)


def test_both_ways_agree_on_improper_vectors(spark):
    odd = [[math.nan] + [1.0] * 63, [None] + [1.0] * 63, [0.0] * 64, [math.inf] + [1.0] * 63]
    asked = made(10, 40, dim=64) + [(900 + i, v) for i, v in enumerate(odd)]
    items = made(11, 300, dim=64) + [(-1 - i, v) for i, v in enumerate(odd)]
    queries, frame = frames(spark, asked, items)
    columns = ["query_id", "rank", "concept_id"]
    scanned = sorted(map(tuple, vectors.nearest_vectors(queries, frame, 5).select(*columns).collect()))
    blocks = vector_grid.nearest_by_blocks(queries, frame, 5, 50).select(*columns)
    assert scanned == sorted(map(tuple, blocks.collect()))
    assert len(scanned) == 5 * len(asked)
    proper = [(q, v) for q, v in asked if q < 40]
    assert [r for r in scanned if r[0] < 40] == brute_force(proper, [x for x in items if 0 <= x[0] < 300], 5)
    assert [r[2] for r in scanned if r[0] == 900] == [-4, -3, -2, -1, 0]


def test_large_query_sets_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 10)
    asked, items = made(7, 20), made(8, 40)
    queries, frame = frames(spark, asked, items)
    found = vectors.nearest_vectors(queries, frame, 2).select("query_id", "rank", "concept_id")
    assert sorted(map(tuple, found.collect())) == brute_force(asked, items, 2)


def test_blocks_without_vectors(spark):
    queries, items = frames(spark, made(9, 3), [])
    assert vector_grid.nearest_by_blocks(queries, items, 2).collect() == []


def test_vectors_of_different_length_fail(spark):
    queries, items = frames(spark, [(1, [1.0, 2.0])], [(1, [1.0])])
    with pytest.raises(PySparkException, match="vectors differ in length"):
        vectors.nearest_vectors(queries, items, 1).collect()


def test_first_n_breaks_ties_by_id():
    query, distance, ids = vector_blocks.first_n(
        np.array([0, 0, 0, 1]), np.array([0.5, 0.5 + 1e-15, 0.1, np.nan]), np.array([9, 3, 7, 1]), 2
    )
    assert query.tolist() == [0, 0, 1] and ids.tolist() == [7, 3, 1]
    assert math.isnan(distance[2])


def test_no_concepts_at_all(spark, vocab):
    empty = Vocabulary.of({"concept": vocab.concept.limit(0), "concept_embedding": vocab.concept_embedding})
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<float>")
    assert vectors.nearest_concepts_batch(queries, empty, 5).collect() == []


def test_bundles_equal_brute_force(spark):
    items = made(21, 90, copies=5)
    queries, frame = frames(spark, items[:60], items)
    found = vector_grid.nearest_by_blocks(queries, frame, 3, 4, bundle_bytes=20 * 4 * 8)
    assert sorted((r.query_id, r["rank"], r.concept_id) for r in found.collect()) == brute_force(items[:60], items, 3)


def test_copies_grow_with_bundles_and_not_with_blocks():
    assert vector_blocks.bundles(100_000, 64, 100_000 // 512) == vector_blocks.LEAST_BUNDLES
    assert vector_blocks.bundles(1_000_000, 64, 1_000_000 // 512) == 16
    assert vector_blocks.bundles(1_000, 64, 2) == 2
    assert vector_blocks.bundles(0, 0, 0) == 1


def test_pairs_are_ranked_in_little_memory():
    draw = np.random.default_rng(3)
    queries, units = (vector_blocks.unit_rows(draw.normal(size=(rows, 8))) for rows in (6000, 9000))
    tracemalloc.start()
    query, distance, ids = vector_blocks.top_pairs(queries, units, np.arange(9000), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert query.tolist() == np.repeat(np.arange(6000), 4).tolist()
    assert ids.reshape(-1, 4)[::500].tolist() == np.argsort(1.0 - queries[::500] @ units.T, axis=1)[:, :4].tolist()


def test_a_column_of_vectors_is_made_of_doubles_in_slices():
    draw = np.random.default_rng(4)
    values = draw.normal(size=(60_000, 16)).astype(np.float32)
    column = pa.ListArray.from_arrays(pa.array(np.arange(60_001) * 16, pa.int32()), pa.array(values.ravel()))
    whole = vector_blocks.unit_rows(vector_blocks.list_matrix(column))
    tracemalloc.start()
    units = vector_blocks.Units(pa.chunked_array([column]))
    found = units[50_000:50_512]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert units.shape == (60_000, 16) and peak < 1_000_000
    assert np.array_equal(found, whole[50_000:50_512])
    rows = np.array([3, 59_999, 7])
    assert np.array_equal(units.take(rows), whole[rows])
    with pytest.raises(ValueError, match="differ in length"):
        vector_blocks.Units(pa.array([[1.0], [1.0, 2.0]]))


def test_middling_sets_are_dealt_to_several_tasks(spark):
    """10,000 vectors on either side are more than a block, so more than one task ranks them."""
    frame = spark.range(10_000).selectExpr("id concept_id", "array(sin(id), cos(id), 1.0) embedding")
    queries = frame.selectExpr("concept_id query_id", "embedding vector")
    ranked = vector_grid.nearest_by_blocks(queries, frame, 1)
    assert "sequence(0, 2" in ranked._jdf.queryExecution().logical().toString()
