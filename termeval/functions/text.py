"""Text normalisation, lexemes and search terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The English stop words of PostgreSQL's full-text search.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now",
)

# Search terms are split at whitespace.
WORD_BREAK = r"[\s\x0b\p{Z}]+"

# A lexeme is a run of letters and digits.
LEXEME_BREAK = r"[^\p{L}\p{N}]+"


def normalise(text: Column) -> Column:
    """Lower-case and strip, the form uncased comparisons work on."""
    return F.lower(F.btrim(text, F.lit(WHITESPACE)))


def without_stop_words(words: Column, stop_words: Sequence[str]) -> Column:
    dropped = ["", *stop_words]
    return F.filter(words, lambda word: ~word.isin(dropped))


def lexemes(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-cased words of ``text`` without stop words."""
    words = F.split(F.lower(text), LEXEME_BREAK)
    return F.array_distinct(without_stop_words(words, stop_words))


def search_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Whitespace-separated lower-cased words of a search term, in order."""
    return without_stop_words(F.split(F.lower(text), WORD_BREAK), stop_words)


def preprocess_search_term(
    text: Column, stop_words: Sequence[str] = STOP_WORDS
) -> Column:
    """``paracetamol and caffeine`` becomes ``paracetamol | caffeine``."""
    return F.array_join(search_words(text, stop_words), " | ")
