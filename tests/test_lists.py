import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from termeval.functions import lists
from termeval.operators.list_scores import list_scores

CASES = [
    (["a", "b", "c", "d"], ["a", "c", "x"], 0.5, 2 / 3),
    (["a", "a", "b"], ["a"], 2 / 3, 2.0),
    (["a"], [], 0.0, None),
    ([], ["a"], None, 0.0),
    ([], [], None, None),
    (["x"], ["a"], 0.0, 0.0),
    (["a", None], ["a", None], 0.5, 0.5),
    (["b", "a"], ["a", "a"], 0.5, 0.5),
]


def f_score(p, r, beta):
    if p is None or r is None or p == r == 0:
        return None
    return (1 + beta**2) * p * r / (beta**2 * p + r)


def test_array_scores(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "p array<string>, a array<string>")
    p, a = F.col("p"), F.col("a")
    found = df.select(lists.precision(p, a), lists.recall(p, a), lists.f_score(p, a, 2.0)).collect()
    for row, (_, _, precision, recall) in zip(found, CASES):
        assert row[0] == pytest.approx(precision)
        assert row[1] == pytest.approx(recall)
        assert row[2] == pytest.approx(f_score(precision, recall, 2.0))


def test_null_lists_have_no_score(spark):
    df = spark.createDataFrame([(None, ["a"]), (["a"], None)], "p array<string>, a array<string>")
    p, a = F.col("p"), F.col("a")
    assert [tuple(r) for r in df.select(lists.precision(p, a), lists.recall(p, a)).collect()] == [
        (None, None),
        (None, None),
    ]


def test_undefined_scores_can_fail(spark):
    df = spark.createDataFrame([([], ["a"])], "p array<string>, a array<string>")
    with pytest.raises(PySparkException, match="score undefined"):
        df.select(lists.precision(F.col("p"), F.col("a"), "error")).collect()
    with pytest.raises(ValueError):
        lists.precision(F.col("p"), F.col("a"), "zero")


def test_scores_of_lists_given_as_rows(spark):
    def items(side):
        data = [(i, item) for i, case in enumerate(CASES) for item in case[side]]
        return spark.createDataFrame(data, "row_id int, item string")

    found = list_scores(items(0), items(1), spark.range(len(CASES)).withColumnRenamed("id", "row_id"), 2.0)
    for row in found.collect():
        precision, recall = CASES[row.row_id][2:]
        assert row.precision == pytest.approx(precision)
        assert row.recall == pytest.approx(recall)
        assert row.f_score == pytest.approx(f_score(precision, recall, 2.0))
    assert found.count() == len(CASES)


def test_relevant_items_as_a_set(spark):
    predicted = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "row_id int, item string")
    relevant = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "row_id int, item string")
    rows = spark.createDataFrame([(1,), (2,)], "row_id int")
    as_list = list_scores(predicted, relevant, rows).orderBy("row_id").collect()
    as_set = list_scores(predicted, relevant, rows, relevant_is_set=True).orderBy("row_id").collect()
    assert [(r.row_id, r.precision, r.recall) for r in as_list] == [(1, 0.5, 0.5), (2, None, 0.0)]
    assert [(r.row_id, r.precision, r.recall) for r in as_set] == [(1, 0.5, 1.0), (2, None, 0.0)]
