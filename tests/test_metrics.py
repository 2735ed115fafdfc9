import pytest
from pyspark.sql import functions as F

from termeval.plans import metrics as m


def scores(spark, metric, pairs):
    data = [(i, p, a) for i, (p, a) in enumerate(pairs)]
    kind = "array<string>" if isinstance(pairs[0][0], list) else "string"
    names = f"row_id int, {metric.predicted} {kind}, {metric.actual} string"
    scored = metric.apply(spark.createDataFrame(data, names))
    assert scored.count() == len(pairs)
    return [r[0] for r in scored.orderBy("row_id").select(metric.label).collect()]


def test_exact_match_means(spark):
    def mean(pairs):
        found = scores(spark, m.ExactMatch(), pairs)
        return sum(found) / len(found)

    assert mean([("a", "a"), ("b", "b")]) == 1.0
    assert mean([("a", "b"), ("b", "a")]) == 0.0
    assert mean([("a", "a"), ("b", "a")]) == 0.5


def test_uncased_match(spark):
    pairs = [(" A\t", "a"), ("a b", "ab"), (None, "a")]
    assert scores(spark, m.UncasedMatch(), pairs) == [1.0, 0.0, None]


def test_related_name_match(spark, vocab):
    metric = m.RelatedNameUncasedMatch(vocab, ["RxNorm"])
    pairs = [
        ("acetaminophen", "Acetaminophen"),
        (" TYLENOL ", "Acetaminophen"),
        ("Acetaminophen and codeine pill", "acetaminophen"),
        ("Retired product", "Acetaminophen"),
        ("Green Park", "Acetaminophen"),
        ("Tylenol", " Acetaminophen"),
        ("codeine", " Codeine"),
        (None, "Codeine"),
        ("Tylenol", None),
    ]
    assert scores(spark, metric, pairs) == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, None, None]
    everywhere = m.RelatedNameUncasedMatch(vocab)
    assert scores(spark, everywhere, pairs)[3] == 1.0
    assert metric.description


ANCESTOR_PAIRS = [
    ("codeine", "Codeine"),
    ("Opioids; systemic", "codeine"),
    ("opioids; systemic", "codeine"),
    (" opioids; systemic", "codeine"),
    (" codeine", "Codeine"),
    ("Green Park", "Codeine"),
]


def test_ancestor_name_match(spark, vocab):
    metric = m.AncestorNameUncasedMatch(vocab, ["RxNorm"])
    assert scores(spark, metric, ANCESTOR_PAIRS) == [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]


def test_ancestor_name_match_unnormalized(spark, vocab):
    metric = m.AncestorNameUncasedMatch(vocab, ["RxNorm"], normalized=False)
    assert scores(spark, metric, ANCESTOR_PAIRS) == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def test_ancestor_name_match_bounds(spark, vocab):
    metric = m.AncestorNameUncasedMatch(vocab, None, 1, 1)
    pairs = [("opioids; systemic", "codeine"), ("nervous system", "codeine")]
    assert scores(spark, metric, pairs) == [1.0, 0.0]


LISTS = [
    (["Tylenol", "Tylenol", "Acetaminophen and Codeine Pill"], "ACETAMINOPHEN"),
    (["Tylenol", "Tylenol", "granite", "maple"], "Acetaminophen"),
    (["plum", "tylenol"], "Acetaminophen"),
    ([], "Acetaminophen"),
    (None, "Acetaminophen"),
]


def test_related_name_precision(spark, vocab):
    metric = m.RelatedNamePrecision(vocab, ["RxNorm"])
    assert scores(spark, metric, LISTS) == [1.0, 0.5, 0.0, None, None]


def test_ancestor_name_precision(spark, vocab):
    metric = m.AncestorNamePrecision(vocab, ["RxNorm"], min_separation_bound=1)
    pairs = [
        (["Analgesics", "Nervous System"], "codeine"),
        (["Analgesics", "kettle", "Codeine", "Opioids; systemic"], "codeine"),
        (["lemonade", "analgesics"], "codeine"),
        ([None, "Analgesics"], "codeine"),
    ]
    assert scores(spark, metric, pairs) == [1.0, 0.5, 0.0, 0.5]


def test_names_bound_to_other_columns(spark):
    metric = m.ExactMatch(label="first", predicted="x", actual="y")
    df = spark.createDataFrame([(1, "a", "a")], "row_id int, x string, y string")
    assert metric.apply(df).first()["first"] == 1


def test_a_metric_of_ones_own(spark):
    class Starts(m.ColumnMetric):
        description = "Prediction starts with the expected output"

        def expr(self, predicted, actual):
            return F.startswith(predicted, actual).cast("double")

    assert scores(spark, Starts(), [("abc", "ab"), ("ab", "abc")]) == [1.0, 0.0]


def test_list_metrics_follow_options(spark):
    df = spark.createDataFrame([(1, ["a"], ["a", "b"])], "row_id int, retrieved array<string>, relevant array<string>")
    for metric, expected in ((m.PrecisionMetric(), 1.0), (m.RecallMetric(), 0.5), (m.FScoreMetric(1.0), 2 / 3)):
        assert metric.apply(df).first()[metric.label] == pytest.approx(expected)
    assert "2.0" in m.FScoreMetric(2.0).description


def test_exact_match_of_numbers_by_type(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan), (1.5, 1.5), (1.5, None)], "prediction double, expected_output double")
    metric = m.ExactMatch()
    assert [r[metric.label] for r in metric.apply(df).collect()] == [0, 1, 0]
