"""An inverted index of texts, stored as tables, for searches that come again and again.

``words`` tells how many texts hold a word, ``postings`` which, in blocks of bounded size: a word
that many texts hold has many blocks, each of which is a row of its own and meets searches in
whatever task it falls to, so no word is too heavy for one. A search reads the postings of its
rarest clause only; what they name is verified on the whole words of the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termeval.durable import stored_path
from termeval.functions.text import STOP_WORDS
from termeval.operators.search import (
    FOUND_COLUMNS,
    as_clauses,
    asked_words,
    found_by_either,
    meets,
    with_rarest_clause,
    with_words,
)
from termeval.operators.vocabulary import in_vocabularies
from termeval.sources.vocabulary import Vocabulary

# Texts of a block of postings.
BLOCK_TEXTS = 4_096


@dataclass
class TextIndex:
    """``texts (text_id, words, ...)``, ``words (word, n, blocks)`` and ``postings (word, block, ids)``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, texts: DataFrame, path: str | None = None) -> TextIndex:
        """Index texts with an array column ``words`` without repeats, below ``path``.

        Texts get a number, ``text_id``, when they are stored; texts without
        words, or with NULL for them, are stored and never found.
        """
        spark = texts.sparkSession
        index = cls(spark, (path or stored_path(spark, "text-index")).rstrip("/"))
        texts.withColumn("text_id", F.monotonically_increasing_id()).write.parquet(f"{index.path}/texts")
        held = index.table("texts").select("text_id", F.explode("words").alias("word"))
        counted = held.groupBy("word").agg(F.count("*").alias("n"))
        blocks = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
        counted.withColumn("blocks", blocks).write.parquet(f"{index.path}/words")
        placed = held.join(index.table("words").select("word", "blocks"), "word").select(
            "word", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int").alias("block"), "text_id"
        )
        # A block has about as many ids as ``BLOCK_TEXTS``, whatever its word.
        postings = placed.groupBy("word", "block").agg(F.sort_array(F.collect_list("text_id")).alias("ids"))
        postings.sort("word", "block").write.parquet(f"{index.path}/postings")
        return index

    def candidates(self, searches: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """``searches`` with ``_word`` and the texts that hold a word of their ``chosen`` clause.

        ``texts`` are the rows of the table of texts to search among, by default all.
        Texts are looked up once for each word asked, however many searches ask it,
        and meet the searches by word and block, so no match is shuffled.
        """
        texts = self.table("texts") if texts is None else texts
        words = self.table("words").select(F.col("word").alias("_word"), "blocks")
        asked = searches.withColumn("_word", F.explode("chosen")).join(words, "_word")
        postings = self.table("postings").select(F.col("word").alias("_word"), F.col("block").alias("_block"), "ids")
        held = postings.join(asked.select("_word").distinct(), "_word", "left_semi")
        held = held.select("_word", "_block", F.explode("ids").alias("text_id")).join(texts, "text_id")
        asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return asked.join(held, ["_word", "_block"]).drop("_block")

    def matches(self, searches: DataFrame, mode: str = "any", texts: DataFrame | None = None) -> DataFrame:
        """As :func:`termeval.operators.search.matches` over the indexed texts, or over some rows of their table."""
        clauses = searches.withColumn("clauses", as_clauses(mode))
        if mode == "any":
            chosen = clauses.filter(F.size("clauses") > 0).withColumn("chosen", F.flatten("clauses"))
        else:
            frequency = self.table("words").select(F.col("word").alias("_lexeme"), F.col("n").alias("_texts"))
            chosen = with_rarest_clause(clauses, frequency)
        met = self.candidates(chosen, texts)
        return met.filter(meets("clauses", "_word")).drop("text_id", "_word", "chosen", "clauses", "terms", "words")


@dataclass
class ConceptIndex:
    """Indexes of the names and synonyms of the standard concepts of a vocabulary."""

    names: TextIndex
    synonyms: TextIndex
    dictionary: DataFrame | None
    stop_words: Sequence[str]

    @classmethod
    def build(
        cls,
        vocab: Vocabulary,
        path: str | None = None,
        dictionary: DataFrame | None = None,
        stop_words: Sequence[str] = STOP_WORDS,
    ) -> ConceptIndex:
        path = (path or stored_path(vocab.concept.sparkSession, "concept-index")).rstrip("/")
        standard = vocab.concept.filter(F.col("standard_concept") == "S").drop("standard_concept")
        names = with_words(standard, "concept_name", "words", dictionary, stop_words)
        synonyms = with_words(
            vocab.concept_synonym.select("concept_id", "concept_synonym_name").join(standard, "concept_id"),
            "concept_synonym_name",
            "words",
            dictionary,
            stop_words,
        )
        return cls(TextIndex.build(names, f"{path}/names"), TextIndex.build(synonyms, f"{path}/synonyms"), dictionary, stop_words)

    def text_search(
        self,
        searches: DataFrame,
        vocabulary_ids: Sequence[str] | None = None,
        concept_synonym: bool = False,
        mode: str = "any",
    ) -> DataFrame:
        """As :func:`termeval.operators.search.text_search` over the indexed concepts."""
        terms = asked_words(searches, mode, self.dictionary, self.stop_words)

        def found(index: TextIndex) -> DataFrame:
            return index.matches(terms, mode, in_vocabularies(index.table("texts"), vocabulary_ids))

        by_name = found(self.names).withColumn("concept_synonym_name", F.lit(None).cast("string"))
        if concept_synonym:
            by_synonym = found(self.synonyms).select(*FOUND_COLUMNS)
            by_name = found_by_either(by_name.select(*FOUND_COLUMNS), by_synonym)
        return by_name.select(*FOUND_COLUMNS)
