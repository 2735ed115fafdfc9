import pytest
from pyspark.sql import functions as F

from termeval.operators import lookup, search


@pytest.fixture
def searches(spark):
    data = [("t", "tablet"), ("ac", "acetaminophen and codeine"), ("p", "Paracetamol"), ("s", "the")]
    return spark.createDataFrame(data, "query_id string, search_term string")


def test_any_term_in_standard_names(searches, vocab, rows):
    found = search.text_search(searches, vocab)
    assert rows(found, "query_id", "concept_id", "concept_synonym_name") == [
        ("ac", 1, None), ("ac", 12, None), ("ac", 2, None), ("ac", 3, None), ("ac", 4, None),
        ("ac", 5, None), ("t", 12, None), ("t", 3, None),
    ]


def test_all_terms_and_vocabularies(searches, vocab, rows):
    found = search.text_search(searches, vocab, ["RxNorm"], mode="all")
    assert rows(found, "query_id", "concept_id") == [("ac", 4), ("t", 3)]


def test_unknown_mode(searches, vocab):
    with pytest.raises(ValueError):
        search.text_search(searches, vocab, mode="some")


def test_synonyms_give_one_row_each(searches, vocab, rows):
    found = search.text_search(searches, vocab, ["RxNorm"], concept_synonym=True)
    assert rows(found.filter("query_id <> 'ac'"), "query_id", "concept_id", "concept_synonym_name") == [
        ("p", 1, "Paracetamol"),
        ("t", 1, "APAP tablet substance"),
        ("t", 3, None),
        ("t", 9, "Tablet for acid"),
        ("t", 9, "Tablet for acid"),
    ]


def test_synonyms_of_a_concept_found_by_name_too(spark, vocab, rows):
    one = spark.createDataFrame([(1, "acetaminophen paracetamol")], "query_id int, search_term string")
    found = search.text_search(one, vocab, ["RxNorm"], concept_synonym=True)
    assert rows(found, "concept_id", "concept_synonym_name") == [
        (1, "Paracetamol"), (3, None), (4, None),
    ]


def test_dictionary_of_lexemes(spark, vocab, rows):
    dictionary = spark.createDataFrame([("tablets", "tablet"), ("orally", "oral")], "word string, lexeme string")
    one = spark.createDataFrame([(1, "tablets orally")], "query_id int, search_term string")
    assert rows(search.text_search(one, vocab)) == []
    found = search.text_search(one, vocab, mode="all", dictionary=dictionary)
    assert rows(found, "concept_id") == [(3,)]


def test_candidates_are_scored(searches, vocab, rows):
    found = lookup.concept_candidates(searches, vocab, ["RxNorm"])
    assert found.columns == [
        "query_id", "search_term", "concept_name", "concept_id", "vocabulary_id",
        "concept_code", "concept_name_similarity_score",
    ]
    best = found.filter("query_id = 'ac'").orderBy(F.desc("concept_name_similarity_score")).first()
    assert best.concept_id == 4


def test_links_of_candidates(spark, vocab, rows):
    candidates = spark.createDataFrame([(1, 1), (2, 1), (2, 5)], "query_id int, concept_id bigint")
    found = lookup.concept_links(candidates, vocab)
    one = [r for r in rows(found) if r[0] == 1]
    assert one == sorted(
        [
            (1, 1, "CONCEPT_ANCESTOR", 1, "Acetaminophen"),
            (1, 1, "CONCEPT_ANCESTOR", 6, "Analgesics"),
            (1, 1, "CONCEPT_ANCESTOR", 8, "Nervous System"),
            (1, 1, "CONCEPT_RELATIONSHIP", 11, "Tylenol"),
            (1, 1, "CONCEPT_RELATIONSHIP", 4, "Acetaminophen and Codeine Pill"),
            (1, 1, "CONCEPT_RELATIONSHIP", 4, "Acetaminophen and Codeine Pill"),
            (1, 1, "CONCEPT_SYNONYM", None, "APAP tablet substance"),
            (1, 1, "CONCEPT_SYNONYM", None, "Paracetamol"),
        ],
        key=repr,
    )
    assert found.filter("query_id = 2 AND concept_id = 5").count() == 6


def test_one_answer_for_each_term(searches, vocab):
    found = {r.query_id: r for r in lookup.concept_answers(searches, vocab, ["RxNorm"], n=2, n_links=2).collect()}
    assert set(found) == {"t", "ac", "p", "s"}
    assert found["p"].CONCEPT == found["s"].CONCEPT == []
    best = found["ac"].CONCEPT
    assert [c.concept_id for c in best] == [4, 1] and best[0][lookup.SCORE] >= best[1][lookup.SCORE]
    assert list(best[0].asDict()) == [
        "concept_name", "concept_id", "vocabulary_id", "concept_code", "concept_name_similarity_score",
        "CONCEPT_SYNONYM", "CONCEPT_ANCESTOR", "CONCEPT_RELATIONSHIP",
    ]
    (tablet,) = found["t"].CONCEPT
    assert [(x.linked_id, x.linked_name) for x in tablet.CONCEPT_ANCESTOR] == [(1, "Acetaminophen"), (6, "Analgesics")]


def test_answers_of_no_terms(searches, vocab):
    assert lookup.concept_answers(searches.limit(0), vocab).count() == 0
