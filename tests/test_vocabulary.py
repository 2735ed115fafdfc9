import pytest

from termeval.operators import vocabulary as v
from termeval.sources.vocabulary import Vocabulary


@pytest.fixture
def seeds(spark):
    data = [("a", "ACETAMINOPHEN"), ("c", "codeine"), ("x", "unknown"), ("p", " codeine")]
    return spark.createDataFrame(data, "query_id string, name string")


def test_name_lookup_ignores_case_but_not_padding(seeds, vocab, rows):
    found = v.ids_matching_name(seeds, vocab)
    assert rows(found) == [("a", 1), ("a", 2), ("c", 5)]


@pytest.mark.parametrize("vocabularies", [None, []])
def test_no_vocabularies_is_no_filter(seeds, vocab, rows, vocabularies):
    assert len(rows(v.ids_matching_name(seeds, vocab, vocabularies))) == 3


def test_vocabulary_filter(seeds, vocab, rows):
    assert rows(v.ids_matching_name(seeds, vocab, ["RxNorm"])) == [("a", 1), ("c", 5)]


def test_related_keeps_repeats_and_filters_only_the_seed(seeds, vocab, rows):
    found = v.related_by_name(seeds, vocab, ["RxNorm"])
    assert rows(found, "query_id", "concept_id") == [("a", 11), ("a", 4), ("a", 4), ("c", 4)]
    assert found.columns[1:] == vocab.concept.columns


def test_ancestors_cross_vocabularies(seeds, vocab, rows):
    found = v.ancestors_by_name(seeds, vocab, ["RxNorm"])
    assert rows(found, "query_id", "concept_id") == [
        ("a", 1), ("a", 6), ("a", 8), ("c", 5), ("c", 6), ("c", 7), ("c", 8),
    ]


# Codeine's ancestors: 5 at (0, 0), 6 at (1, 2), 7 at (1, 1), 8 at (2, 2).
@pytest.mark.parametrize(
    "minimum, maximum, expected",
    [
        (0, None, [5, 6, 7, 8]),
        (0, 0, [5]),
        (0, 1, [5, 7]),
        (1, None, [6, 7, 8]),
        (1, 1, [7]),
        (1, 2, [6, 7, 8]),
        (2, 2, [8]),
        (3, None, []),
    ],
)
def test_bounds_on_ancestors(spark, vocab, rows, minimum, maximum, expected):
    seed = spark.createDataFrame([(1, "Codeine")], "query_id int, name string")
    found = v.ancestors_by_name(seed, vocab, None, minimum, maximum)
    assert [i for (i,) in rows(found, "concept_id")] == expected


# Nervous System's descendants: 6 at (1, 1), 1 at (2, 3), 5 at (2, 2), 3 at (3, 4).
@pytest.mark.parametrize(
    "minimum, maximum, expected",
    [
        (0, None, [1, 3, 5, 6]),
        (0, 0, []),
        (0, 2, [5, 6]),
        (2, None, [1, 3, 5]),
        (2, 2, [5]),
        (2, 3, [1, 5]),
    ],
)
def test_bounds_on_descendants(spark, vocab, rows, minimum, maximum, expected):
    seed = spark.createDataFrame([(1, "nervous system")], "query_id int, name string")
    found = v.descendants_by_name(seed, vocab, None, minimum, maximum)
    assert [i for (i,) in rows(found, "concept_id")] == expected


def test_lookup_by_id(spark, vocab, rows):
    ids = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "query_id int, concept_id bigint")
    assert rows(v.related_by_id(ids, vocab), "query_id", "concept_id") == [
        (7, 11), (7, 4), (7, 4), (8, 11), (8, 4), (8, 4), (9, 10),
    ]
    assert len(rows(v.ancestors_by_id(ids, vocab, 1))) == 4
    assert rows(v.descendants_by_id(ids, vocab, 1), "query_id", "concept_id") == [(7, 3), (8, 3)]


def test_all_vocabularies(vocab, rows):
    assert rows(v.all_vocabularies(vocab)) == [("ATC",), ("RxNorm",), ("SNOMED",)]


def test_name_pairs_are_distinct_and_only_those_asked_for(spark, vocab, rows):
    wanted = spark.createDataFrame(
        [("acetaminophen", "acetaminophen and codeine pill"), ("acetaminophen", "other")] * 3,
        "seed_key string, target_key string",
    )
    pairs = v.name_pairs(v.related_edges(vocab), vocab, wanted)
    assert rows(pairs) == [("acetaminophen", "acetaminophen and codeine pill")]


def test_vocabulary_casts_and_checks_columns(spark, rows):
    concept = spark.createDataFrame(
        [(1, "a", "b", "c", "S", "more")],
        "concept_id int, concept_name string, vocabulary_id string, concept_code string, "
        "standard_concept string, more string",
    )
    loaded = Vocabulary.of({"concept": concept, "concept_synonym": concept})
    assert loaded.concept.schema["concept_id"].dataType.simpleString() == "bigint"
    assert rows(loaded.concept) == [(1, "a", "b", "c", "S")]
    with pytest.raises(ValueError, match="concept_synonym_name"):
        loaded.concept_synonym


def test_vocabulary_from_parquet_and_catalog(spark, vocab, rows, tmp_path):
    for name in ("concept", "concept_synonym", "concept_embedding"):
        getattr(vocab, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = Vocabulary.from_parquet(spark, str(tmp_path / "{table}.parquet"))
    assert rows(loaded.concept) == rows(vocab.concept)
    spark.sql("CREATE DATABASE IF NOT EXISTS toy_vocabulary")
    path = tmp_path / "concept.parquet"
    spark.sql("DROP TABLE IF EXISTS toy_vocabulary.concept")
    spark.sql(f"CREATE TABLE toy_vocabulary.concept USING parquet LOCATION '{path}'")
    assert rows(Vocabulary.from_catalog(spark, "toy_vocabulary").concept) == rows(vocab.concept)
    spark.sql("DROP TABLE toy_vocabulary.concept")
    spark.sql("DROP DATABASE toy_vocabulary")
