"""The vector index and the inverted index against the searches without one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termeval.operators import search, text_index, vector_index, vectors
from termeval.operators.text_index import ConceptIndex, TextIndex


def clustered(seed, size, dim=16, clusters=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dim))
    rows = centres[draw.integers(clusters, size=size)] + 0.3 * draw.normal(size=(size, dim))
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows)]


def frame(spark, items):
    return spark.createDataFrame(items, "concept_id bigint, embedding array<double>").repartition(4)


def asked(items):
    return items.select(F.col("concept_id").alias("query_id"), F.col("embedding").alias("vector"))


def ranked(found):
    return sorted((r.query_id, r.rank, r.concept_id, round(r.score, 9)) for r in found.collect())


def recall(found, exact):
    ours, theirs = ({(r.query_id, r.concept_id) for r in x.collect()} for x in (found, exact))
    return len(ours & theirs) / len(theirs)


@pytest.mark.parametrize("seed", [1, 2])
def test_probing_every_cell_is_the_exact_search(spark, seed):
    items = frame(spark, clustered(seed, 400))
    index = vector_index.build(items)
    queries = asked(items)
    exact = vectors.nearest_vectors(queries, items, 5)
    assert ranked(index.search(queries, 5, probes=len(index.centroids))) == ranked(exact)


def test_measured_cells_reach_the_recall_wanted(spark):
    items = frame(spark, clustered(3, 3_000))
    index = vector_index.build(items, recall=0.95)
    assert index.recall >= 0.95 and index.probes < len(index.centroids) / 2
    queries = asked(items)
    exact = vectors.nearest_vectors(queries, items, 10)
    assert recall(index.search(queries, 10), exact) >= 0.9


def test_recall_on_vectors_without_clusters(spark):
    draw = np.random.default_rng(4)
    items = frame(spark, [(i, [float(x) for x in draw.normal(size=32)]) for i in range(1_500)])
    index = vector_index.build(items)
    queries = asked(items)
    assert recall(index.search(queries, 10), vectors.nearest_vectors(queries, items, 10)) >= 0.9


def test_a_large_query_set_is_dealt_by_cells(spark, monkeypatch):
    items = frame(spark, clustered(5, 600))
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 40)
    index = vector_index.build(items)
    assert max(index.blocks.values()) > 1
    queries = asked(items)
    scanned = ranked(index.search(queries, 4, probes=5))
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 10)
    assert ranked(index.search(queries, 4, probes=5)) == scanned


def test_an_index_is_opened_again_and_holds_every_row(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    improper = [(1000, [0.0] * 16), (1001, [nan] + [1.0] * 15), (1002, [inf] * 16), (1003, None), (1004, [None] + [1.0] * 15)]
    items = frame(spark, clustered(6, 200) + improper)
    built = vector_index.build(items, str(tmp_path / "index"))
    index = vector_index.VectorIndex.open(spark, str(tmp_path / "index"))
    assert (index.probes, index.recall, index.blocks) == (built.probes, built.recall, built.blocks)
    held = {r.concept_id: r.cell for r in index.vectors.collect()}
    # A row without a vector is not stored; one without a direction is, apart from the others.
    assert set(held) == {*range(200), 1000, 1001, 1002, 1004}
    assert {i for i, cell in held.items() if cell < 0} == {1000, 1001, 1002, 1004}
    found = index.search(asked(items), 3).collect()
    assert {r.query_id for r in found} == set(range(200)) and {r.concept_id for r in found} <= set(range(200))


def test_an_index_of_nothing(spark):
    items = frame(spark, [])
    index = vector_index.build(items)
    assert index.search(asked(frame(spark, clustered(1, 3))).where("false"), 3).count() == 0


# Inverted index

NAMES = [(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in ("red", "blue", "hot", "the") for b in ("bolt", "ring", "red"))]
CLAUSES = [
    (1, [["red", "blue"], ["bolt"]]),
    (2, [["red"], ["red"]]),
    (3, [["missing"], ["bolt"]]),
    (4, [[], ["hot"]]),
    (5, []),
    (6, [[]]),
    (7, [["bolt", "ring"], ["hot", "missing", "red"], ["ring", "hot"]]),
    (8, None),
]


def texts(spark):
    df = spark.createDataFrame(NAMES + [(90, ""), (91, None)], "id int, name string").repartition(3)
    return search.with_words(df, "name", "words")


def by_hand():
    found = []
    for query, clauses in CLAUSES:
        clauses = [c for c in clauses or [] if c]
        for i, name in NAMES:
            if clauses and all(set(c) & (set(name.split()) - {"the"}) for c in clauses):
                found.append((query, i))
    return sorted(found)


def pairs_of(df):
    return sorted((r.query_id, r.id) for r in df.collect())


def test_clauses_by_hand(spark):
    searches = spark.createDataFrame(CLAUSES, "query_id int, clauses array<array<string>>")
    assert pairs_of(search.matches(searches, texts(spark), "clauses")) == by_hand()
    assert pairs_of(TextIndex.build(texts(spark)).matches(searches, "clauses")) == by_hand()


@pytest.mark.parametrize("mode", ["any", "all"])
def test_index_equals_search_without_one(spark, monkeypatch, mode):
    monkeypatch.setattr(text_index, "BLOCK_TEXTS", 2)
    terms = [(1, ["red", "bolt"]), (2, ["ring"]), (3, []), (4, ["missing", "hot"]), (5, ["blue", "bolt", "red"])]
    searches = spark.createDataFrame(terms, "query_id int, terms array<string>")
    index = TextIndex.build(texts(spark))
    assert index.table("words").agg(F.max("blocks")).first()[0] > 1
    assert pairs_of(index.matches(searches, mode)) == pairs_of(search.matches(searches, texts(spark), mode))


@pytest.mark.parametrize("synonyms", [False, True])
@pytest.mark.parametrize("vocabularies", [None, ["RxNorm"]])
def test_concept_index_equals_text_search(spark, vocab, rows, synonyms, vocabularies):
    data = [("t", "tablet"), ("ac", "acetaminophen and codeine"), ("p", "Paracetamol"), ("s", "the")]
    searches = spark.createDataFrame(data, "query_id string, search_term string")
    index = ConceptIndex.build(vocab)
    for mode in ("any", "all"):
        found = index.text_search(searches, vocabularies, synonyms, mode)
        assert rows(found) == rows(search.text_search(searches, vocab, vocabularies, synonyms, mode))


def test_a_word_of_half_of_all_texts_is_spread(spark, monkeypatch):
    """Postings of a hot word lie in many rows of about equal size, dealt over the tasks."""
    monkeypatch.setattr(text_index, "BLOCK_TEXTS", 200)
    rng = random.Random(1)
    words = [(i, ["hot"] * (i % 2) + [f"w{rng.randrange(5_000)}"]) for i in range(40_000)]
    index = TextIndex.build(spark.createDataFrame(words, "id int, words array<string>"))
    sizes = index.table("postings").where("word = 'hot'").select(F.size("ids").alias("n")).toPandas()["n"]
    assert len(sizes) == 100 and sizes.max() <= 2 * sizes.median()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        searches = spark.createDataFrame([(1, [["hot"]])], "query_id int, chosen array<array<string>>")
        met = index.candidates(searches.withColumn("chosen", F.flatten("chosen")))
        tasks = met.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks.sum() == 20_000 and len(tasks) > 1 and tasks.max() <= 2 * tasks.median()


@pytest.mark.parametrize("probes", [3, 100])
def test_bundles_of_cells_are_probed_as_in_the_scan(spark, probes):
    items = clustered(31, 400)
    index = vector_index.build(frame(spark, items), cells=9)
    queries = frame(spark, items).selectExpr("concept_id AS query_id", "embedding AS vector")
    probes = min(probes, len(index.centroids))
    dealt = vector_index.best_per_query(index._dealt(queries, 4, probes, bundle_bytes=60 * 16 * 8), 4)
    scanned = index.search(queries, 4, probes=probes)
    columns = "query_id", "rank", "concept_id"
    assert sorted(map(tuple, dealt.select(*columns).collect())) == sorted(map(tuple, scanned.select(*columns).collect()))


def test_searches_of_an_index_share_its_texts(spark):
    """However many searches ask a word, its texts are looked up once, so candidates carry whole texts."""
    words = [(i, ["red", "bolt"] if i % 2 else ["red"]) for i in range(10)]
    index = text_index.TextIndex.build(spark.createDataFrame(words, "id long, words array<string>"))
    searches = spark.createDataFrame([(q, ["bolt"]) for q in range(3)], "query_id long, chosen array<string>")
    some = index.table("texts").filter("id < 4")
    met = index.candidates(searches, some)
    assert sorted((r.query_id, r.id, r.words) for r in met.collect()) == [(q, i, ["red", "bolt"]) for q in range(3) for i in (1, 3)]


def test_a_large_query_set_probes_in_slices(spark, monkeypatch):
    """What a task places at once is bounded in queries times cells, with the same rows found."""
    index = vector_index.build(frame(spark, clustered(33, 300)), cells=20)
    queries = frame(spark, clustered(33, 300)).selectExpr("concept_id AS query_id", "embedding AS vector")
    scanned = index.search(queries, 4, probes=2).select("query_id", "rank", "concept_id")
    monkeypatch.setattr(vector_index, "BLOCK_ELEMENTS", 60)
    dealt = vector_index.best_per_query(index._dealt(queries, 4, 2), 4).select("query_id", "rank", "concept_id")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, scanned.collect()))
