import math
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from termeval.functions import similarity


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        above = row[:]
        for j, b in enumerate(y, 1):
            row[j] = above[j - 1] + 1 if a == b else max(above[j], row[j - 1])
    return row[-1]


def ratio(x, y):
    total = len(x) + len(y)
    return 100 * (1 - (total - 2 * lcs(x, y)) / total) if total else 100.0


letters = st.text(alphabet="abcd é𝒳\0", max_size=90)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(letters, letters), min_size=1, max_size=5))
def test_ratios_equal_dynamic_programming(pairs):
    assert similarity._indel_ratios(pairs).tolist() == [ratio(x, y) for x, y in pairs]


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 200])
def test_ratios_at_word_boundaries(length):
    x, y = "ab" * (length // 2) + "a" * (length % 2), "ba" * 40
    assert similarity._indel_ratios([(x, y)]).tolist() == [ratio(x, y)]


def test_long_and_mixed_lengths_equal_dynamic_programming():
    rng = random.Random(7)
    pairs = [
        ("".join(rng.choices("abé", k=rng.choice([0, 1, 64, 65, 128, 129, 300]))), "".join(rng.choices("ab𝒳", k=rng.randrange(400))))
        for _ in range(60)
    ]
    # Runs of one letter carry through all words.
    pairs += [("a" * 500, "a" * 499 + "b"), ("b" + "a" * 300, "a" * 300 + "b"), ("a" * 64, "a" * 640)]
    assert similarity._indel_ratios(pairs).tolist() == [ratio(x, y) for x, y in pairs]


def test_groups_hold_pairs_of_like_lengths(monkeypatch):
    monkeypatch.setattr(similarity, "_GROUP_BYTES", 1_000)
    rng = random.Random(8)
    pairs = [("".join(rng.choices("abcd", k=rng.randrange(1, 30))), "".join(rng.choices("abcd", k=rng.randrange(30, 300)))) for _ in range(80)]
    assert len(list(similarity._groups(pairs))) > 5
    assert similarity._indel_ratios(pairs).tolist() == [ratio(x, y) for x, y in pairs]


# Expected name and the published ratio of a reply with one extra blank.
@pytest.mark.parametrize(
    "name, golden",
    [
        ("memantine hydrochloride", 97.87234042553192),
        ("amitriptyline", 96.2962962962963),
        ("ropinirole", 95.23809523809523),
        ("trazodone", 94.73684210526316),
    ],
)
def test_golden_ratios(spark, name, golden):
    df = spark.createDataFrame([(f" {name.upper()}", name)], "p string, a string")
    assert df.select(similarity.fuzzy_ratio(F.col("p"), F.col("a"))).first()[0] == golden


def test_fuzzy_ratio_nulls_empty_and_symmetry(spark):
    data = [("", "", 100.0), (None, "a", None), ("a", None, None), ("", "abc", 0.0), ("Kitten", "sitting", ratio("kitten", "sitting"))]
    df = spark.createDataFrame([r[:2] for r in data], "p string, a string")
    there = [r[0] for r in df.select(similarity.fuzzy_ratio(F.col("p"), F.col("a"))).collect()]
    back = [r[0] for r in df.select(similarity.fuzzy_ratio(F.col("a"), F.col("p"))).collect()]
    assert there == back == [r[2] for r in data]


def test_exact_match_with_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "A"), (None, None), ("a", None)], "p string, a string")
    assert [r[0] for r in df.select(similarity.exact_match(F.col("p"), F.col("a"))).collect()] == [1, 0, 0, 0]
    nan = spark.createDataFrame([(math.nan, math.nan), (1.0, 1.0), (None, 1.0)], "p double, a double")
    found = nan.select(similarity.exact_match_float(F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in found] == [0, 1, 0]


def test_dot_and_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])],
        "a array<float>, b array<double>",
    )
    a, b = F.col("a"), F.col("b")
    found = df.select(similarity.dot(a, b), similarity.cosine(a, b)).collect()
    assert found[0][0] == 11.0
    assert found[0][1] == pytest.approx(11 / (math.sqrt(5) * 5), abs=1e-12)
    assert found[1][0] == 0.0 and math.isnan(found[1][1])
    assert found[2][0] is None and found[2][1] is None


def test_vectors_of_different_length_fail(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(PySparkException, match="vectors differ in length"):
        df.select(similarity.dot(F.col("a"), F.col("b"))).collect()


def test_pairs_of_long_texts_are_compared_in_little_memory():
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefgh ", k=700)) for _ in range(6001)]
    pairs = list(zip(texts, texts[1:]))
    tracemalloc.start()
    found = similarity._indel_ratios(pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert found[:3].tolist() == similarity._indel_ratios(pairs[:3]).tolist()
