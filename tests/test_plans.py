"""Plans stay as intended: pushdown, pruning, partial aggregation, spread keys."""

import re

import pytest
from pyspark.sql import functions as F

from termeval.operators import list_scores, search, vectors, vocabulary
from termeval.sources.vocabulary import Vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, vocab, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vocabulary")
    for name in ("concept", "concept_relationship", "concept_ancestor", "concept_embedding"):
        getattr(vocab, name).write.parquet(str(folder / name))
    return Vocabulary.from_parquet(spark, str(folder))


def scans(df):
    return [line for line in plan(df).splitlines() if "FileScan" in line]


def test_filters_and_columns_reach_the_scan(spark, stored):
    seeds = spark.createDataFrame([(1, "codeine")], "query_id int, name string")
    (scan,) = scans(vocabulary.ids_matching_name(seeds, stored, ["RxNorm"]))
    assert "IsNotNull" not in scan or "vocabulary_id" in scan
    assert re.search(r"PushedFilters: \[.*(EqualTo|In)\(vocabulary_id", scan)
    assert "ReadSchema: struct<concept_id:bigint,concept_name:string,vocabulary_id:string>" in scan


def test_bounds_reach_the_scan(spark, stored):
    ids = spark.createDataFrame([(1, 5)], "query_id int, concept_id bigint")
    found = vocabulary.ancestors_by_id(ids, stored, 1, 2)
    (scan,) = [s for s in scans(found) if "ancestor_concept_id" in s]
    assert "GreaterThanOrEqual(min_levels_of_separation,1)" in scan
    assert "LessThanOrEqual(max_levels_of_separation,2)" in scan


def test_related_reads_only_the_ids_of_edges(spark, stored):
    ids = spark.createDataFrame([(1, 5)], "query_id int, concept_id bigint")
    (scan,) = [s for s in scans(vocabulary.related_by_id(ids, stored)) if "concept_id_1" in s]
    assert "ReadSchema: struct<concept_id_1:bigint,concept_id_2:bigint>" in scan


def test_single_vector_query_takes_ordered(stored):
    found = plan(vectors.nearest_concepts([1.0, 0.0, 0.0], stored, 3))
    assert "TakeOrderedAndProject" in found


def test_names_are_joined_after_the_limit(stored):
    found = plan(vectors.nearest_concepts([1.0, 0.0, 0.0], stored, 3))
    lines = found.splitlines()
    depths = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    (top,) = (i for i, line in enumerate(lines) if "TakeOrderedAndProject" in line)
    stop = next((i for i in range(top + 1, len(lines)) if depths[i] <= depths[top]), len(lines))
    assert "concept_name" in found and not any("concept_name" in line for line in lines[top:stop])


def test_list_counts_combine_before_each_shuffle(spark):
    items = spark.range(10).select(F.col("id").alias("row_id"), F.lit("a").alias("item"))
    found = plan(list_scores.list_counts(items, items, items.select("row_id").distinct()))
    assert found.count("partial_sum") >= 3 and "collect_list" not in found and "Join" not in found


def test_hot_row_of_a_list_is_spread(spark):
    """A third of all items in one row: no task receives them as they are."""
    size = 30000
    row = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    items = spark.range(size).select(row.alias("row_id"), F.concat(F.lit("n"), F.col("id") % 50).alias("item"))
    relevant = items.distinct()
    rows = items.select("row_id").distinct()
    found = list_scores.list_scores(items, relevant, rows)
    hot = found.filter("row_id = 0").first()
    assert hot.precision == 1.0 and hot.recall == size / 3 / 50
    assert found.count() == rows.count()


def test_synonym_matches_are_not_gathered(spark, vocab):
    """A task that gathered its matches to tell repeats would hold them all."""
    searches = spark.createDataFrame([("t", "tablet")], "query_id string, search_term string")
    found = plan(search.text_search(searches, vocab, concept_synonym=True))
    assert "Aggregate" not in found and "LeftAnti" in found
