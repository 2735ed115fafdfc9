import pytest
from pyspark.sql import functions as F

from termeval.functions import prompts, text


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


@pytest.mark.parametrize(
    "term, expected",
    [
        ("paracetamol", "paracetamol"),
        ("paracetamol caffeine", "paracetamol | caffeine"),
        ("paracetamol and caffeine", "paracetamol | caffeine"),
        ("  The Paracetamol\t\ncaffeine ", "paracetamol | caffeine"),
        ("a b", "b"),
        ("and", ""),
        (None, None),
    ],
)
def test_search_term(spark, term, expected):
    assert one(spark, text.preprocess_search_term(F.col("t")), t=term) == expected


def test_lexemes_are_distinct_words_without_stop_words(spark):
    found = one(spark, text.lexemes(F.col("t")), t="The Pill/Tablet, pill of 5 mg (élan)")
    assert found == ["pill", "tablet", "5", "mg", "élan"]


@pytest.mark.parametrize("padded", [" A b\t", "\n\x0ba B\x0c\r", " A B 　", "\x1ca b\x85"])
def test_normalise_strips_as_python_does(spark, padded):
    assert one(spark, text.normalise(F.col("t")), t=padded) == padded.strip().lower() == "a b"


def test_simple_prompt(spark):
    rendered = prompts.naming_prompt(F.col("t"), "Name it.", "llama-3-8b")
    shown = one(spark, rendered, t="plum")
    assert shown == "Name it.\n\nInformal name: plum\nResponse:"
    with_token = prompts.naming_prompt(F.col("t"), "Name it.", "llama-3.1-8b")
    assert "plum<|eot_id|>" in one(spark, with_token, t="plum")
    assert one(spark, rendered, t=None) is None


def test_end_of_turn_of_a_column(spark):
    models = spark.createDataFrame([("llama-3.1-8b",), ("other",), (None,)], "m string")
    tokens = [r[0] for r in models.select(prompts.end_of_turn(F.col("m"))).collect()]
    assert tokens == ["<|eot_id|>", "", ""]


def test_prompt_with_documents(spark):
    documents = F.array(
        F.struct(F.lit("quince").alias("content"), F.lit(0.25).alias("score")),
        F.struct(F.lit("pear").alias("content"), F.lit(0.5).alias("score")),
    )
    plain = prompts.naming_prompt(
        F.col("t"), "Name it.", "llama-3.1-8b", prompts.document_lines(documents)
    )
    shown = one(spark, plain, t="plum")
    assert "Possible related terms:\n    quince\n    pear\n" in shown
    assert "plum<|eot_id|>" in shown
    scored = one(spark, prompts.scored_document_lines(documents), t="x")
    assert scored.splitlines()[0] == "    quince (cosine distance = 0.2500)"
    similar = one(spark, prompts.scored_document_lines(documents, 2, True), t="x")
    assert similar.splitlines()[0] == "    quince (cosine similarity = 0.75)"
