"""Full-text search: term sets against the lexemes of concept names.

Texts and searches meet in an equi-join on one lexeme and are then verified
against each other's whole word arrays. A text that matches a search comes out
exactly once, so nothing has to be grouped or deduplicated after the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.functions.text import STOP_WORDS, lexemes
from termeval.operators.vocabulary import in_vocabularies
from termeval.sources.vocabulary import Vocabulary


FOUND_COLUMNS = (
    "query_id",
    "concept_id",
    "concept_name",
    "vocabulary_id",
    "concept_code",
    "concept_synonym_name",
)


def with_words(
    df: DataFrame,
    text: str,
    words: str,
    dictionary: DataFrame | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``df`` with the distinct lexemes of ``text`` as the array ``words``.

    ``dictionary`` is an optional ``(word, lexeme)`` table, one row per word,
    that brings inflected words to one lexeme; words it lacks stay as they are.
    """
    df = df.withColumn(words, lexemes(F.col(text), stop_words))
    if dictionary is None:
        return df
    # Only distinct texts are taken apart and put together again.
    known = dictionary.select(F.col("word").alias("_word"), F.col("lexeme").alias("_lexeme"))
    mapped = (
        df.select(text, words)
        .distinct()
        .select(text, F.explode(words).alias("_word"))
        .join(known, "_word", "left")
        .groupBy(text)
        .agg(F.collect_set(F.coalesce("_lexeme", "_word")).alias(words))
    )
    return df.drop(words).join(mapped, text, "left")


def as_clauses(mode: str) -> Column:
    """The clauses of a search ``mode`` over ``terms``: lists of words, one of each of which a text must have."""
    if mode == "any":
        return F.when(F.size("terms") > 0, F.array("terms")).otherwise(F.array())
    if mode == "all":
        return F.transform("terms", lambda term: F.array(term))
    if mode == "clauses":
        return F.filter("clauses", lambda clause: F.size(clause) > 0)
    raise ValueError("mode must be 'any', 'all' or 'clauses'")


def meets(clauses: str, word: str) -> Column:
    """Whether ``words`` meet all ``clauses``, asked at the first word that meets the clause ``chosen``."""
    common = F.filter("words", lambda x: F.array_contains("chosen", x))
    every = F.forall(clauses, lambda clause: F.arrays_overlap(clause, "words"))
    return (F.get(common, F.lit(0)) == F.col(word)) & every


def with_rarest_clause(searches: DataFrame, frequency: DataFrame) -> DataFrame:
    """``searches`` with the clause the fewest texts can meet, as ``chosen``; those without clauses are left out.

    ``frequency`` has the number of texts, ``_texts``, of each ``_lexeme``.
    """
    columns = searches.columns
    terms = searches.select("*", F.posexplode("clauses").alias("_clause", "_terms"))
    counted = terms.withColumn("_lexeme", F.explode("_terms")).join(frequency, "_lexeme", "left")
    sums = counted.groupBy(*columns, "_clause").agg(
        F.sum(F.coalesce("_texts", F.lit(0))).alias("_texts"), F.any_value("_terms").alias("_terms")
    )
    least = F.min(F.struct("_texts", "_clause", "_terms"))["_terms"]
    return sums.groupBy(*columns).agg(least.alias("chosen"))


def matches(searches: DataFrame, texts: DataFrame, mode: str = "any") -> DataFrame:
    """Searches joined to the texts with any, or all, of their terms, or that meet all of their clauses.

    ``searches`` has an array column ``terms``, ``texts`` one named ``words``,
    both without repeats; all other columns are kept. For ``mode="clauses"``
    ``searches`` has ``clauses``, lists of alternative words, instead. A search
    without terms, or with empty clauses only, matches nothing.
    """
    if mode == "clauses":
        searches = searches.withColumn("clauses", as_clauses(mode))
        asked = searches.select(F.explode(F.flatten("clauses")).alias("_lexeme")).distinct()
        frequency = (
            texts.select(F.explode("words").alias("_lexeme"))
            .join(asked, "_lexeme", "left_semi")
            .groupBy("_lexeme")
            .agg(F.count("*").alias("_texts"))
        )
        keyed = with_rarest_clause(searches, frequency).withColumn("_lexeme", F.explode("chosen"))
        met = keyed.join(texts.withColumn("_lexeme", F.explode("words")), "_lexeme")
        return met.filter(meets("clauses", "_lexeme")).drop("_lexeme", "chosen", "clauses", "words")
    if mode == "any":
        # Of several common words only the first joins.
        keyed = searches.withColumn("_lexeme", F.explode("terms"))
        common = F.filter("words", lambda word: F.array_contains("terms", word))
        verified = F.get(common, F.lit(0)) == F.col("_lexeme")
    elif mode == "all":
        keyed = _by_rarest_term(searches, texts)
        verified = F.forall("terms", lambda term: F.array_contains("words", term))
    else:
        raise ValueError("mode must be 'any', 'all' or 'clauses'")
    met = keyed.join(texts.withColumn("_lexeme", F.explode("words")), "_lexeme")
    return met.filter(verified).drop("_lexeme", "terms", "words")


def _by_rarest_term(searches: DataFrame, texts: DataFrame) -> DataFrame:
    """``searches`` with the term the fewest texts have, as ``_lexeme``.

    A text with all terms has the rarest one too, so meeting there is enough; on
    a common word every search would meet a large share of the texts.
    """
    columns = searches.columns
    terms = searches.withColumn("_lexeme", F.explode("terms"))
    frequency = (
        texts.select(F.explode("words").alias("_lexeme"))
        .join(terms.select("_lexeme").distinct(), "_lexeme", "left_semi")
        .groupBy("_lexeme")
        .agg(F.count("*").alias("_texts"))
    )
    ranked = F.struct(F.coalesce("_texts", F.lit(0)).alias("texts"), F.col("_lexeme").alias("term"))
    return (
        terms.join(frequency, "_lexeme", "left")
        .groupBy(*columns)
        .agg(F.min(ranked)["term"].alias("_lexeme"))
    )


def concept_hits(
    searches: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    concept_synonym: bool = False,
    mode: str = "any",
    dictionary: DataFrame | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """As :func:`text_search`, with the ``search_term`` of each row."""
    terms = asked_words(searches, mode, dictionary, stop_words)
    standard = in_vocabularies(
        vocab.concept.filter(F.col("standard_concept") == "S"), vocabulary_ids
    ).drop("standard_concept")
    names = with_words(standard, "concept_name", "words", dictionary, stop_words)
    by_name = matches(terms, names, mode).withColumn(
        "concept_synonym_name", F.lit(None).cast("string")
    )
    if not concept_synonym:
        return by_name
    # Synonyms meet their concepts before they meet searches: texts are fewer than matches.
    synonyms = with_words(
        vocab.concept_synonym.select("concept_id", "concept_synonym_name").join(standard, "concept_id"),
        "concept_synonym_name",
        "words",
        dictionary,
        stop_words,
    )
    return found_by_either(by_name, matches(terms, synonyms, mode))


def asked_words(
    searches: DataFrame, mode: str, dictionary: DataFrame | None, stop_words: Sequence[str]
) -> DataFrame:
    """``query_id``, ``search_term`` and ``terms``, or for clauses ``query_id`` and ``clauses``."""
    if mode == "clauses":
        return searches.select("query_id", "clauses")
    return with_words(
        searches.select("query_id", "search_term"), "search_term", "terms", dictionary, stop_words
    )


def found_by_either(by_name: DataFrame, by_synonym: DataFrame) -> DataFrame:
    """A row for each matching synonym, and one for each concept found by its name alone."""
    # Repeats do no harm to an anti join; to find them, a task would hold all of its matches.
    both_ways = by_synonym.select("query_id", "concept_id")
    name_only = by_name.join(both_ways, ["query_id", "concept_id"], "left_anti")
    return by_synonym.unionByName(name_only)


def text_search(
    searches: DataFrame,
    vocab: Vocabulary,
    vocabulary_ids: Sequence[str] | None = None,
    concept_synonym: bool = False,
    mode: str = "any",
    dictionary: DataFrame | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Standard concepts whose name matches each search ``(query_id, search_term)``.

    With ``concept_synonym``, concepts with a matching synonym are found too, one
    row per matching synonym; a concept found by its name alone has one row with
    a NULL synonym. For ``mode="clauses"`` searches are ``(query_id, clauses)``:
    lists of alternative lexemes, of each of which a text must have one.
    """
    return concept_hits(
        searches, vocab, vocabulary_ids, concept_synonym, mode, dictionary, stop_words
    ).select(*FOUND_COLUMNS)
