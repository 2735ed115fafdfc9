"""Licence scans: the digest of a canonical text, looked up among those of known licences.

A text is put in lower case, its copyright lines removed, equivalent spellings
made one and everything but letters and digits made single blanks; then its
SHA-256 is joined to the known digests. Each line is looked up in the same way,
so that a notice inside a longer text is found too.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that name the owner of the copyright, not lines that speak of notices.
COPYRIGHT_LINE = (
    r"(?m)^[^\n\p{L}\p{N}]*(?:(?:portions )?copyright[ \t]*(?:\(c\)|©|[0-9<{\[])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
)
# Words that published matching guidelines take as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisation": "capitalization",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright owner": "copyright holder",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non infringement": "noninfringement",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "while": "whilst",
    "wilful": "willful",
}


def canonical(text: Column) -> Column:
    """The text by which licences are compared; empty for a null text.

    Letters and digits of all scripts are kept, apart from those of copyright lines.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    one_form = plain
    for variant, spelling in SPELLINGS.items():
        one_form = F.replace(one_form, F.lit(f" {variant} "), F.lit(f" {spelling} "))
    # Few texts hold any of these words: one search spares the others the replacements.
    held = plain.rlike(" (?:" + "|".join(SPELLINGS) + ") ")
    return F.trim(F.regexp_replace(F.when(held, one_form).otherwise(plain), " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``digest``, ``licence``, ``notices`` of every document.

    ``known`` has ``name`` and ``text``. ``licence`` is the known text that the whole
    text equals, or null; ``notices`` are the sorted names of all that it or a
    line of it equals. Texts without a letter or digit, null ones included, equal
    nothing. Of several names for one text the first is taken. Rows alike in id
    and canonical text come out once; other columns are left out.
    """
    names = (
        known.where(canonical(F.col("text")) != "")
        .groupBy(digest(F.col("text")).alias("unit"))
        .agg(F.min("name").alias("name"))
    )
    whole = digest(F.col(text_col))
    lines = F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), digest))
    units = df.select(F.col(id_col).alias("key"), whole.alias("digest"), lines.alias("lines")).select(
        "key", "digest", F.explode(F.array_union(F.array("digest"), F.coalesce("lines", F.array().cast("array<string>")))).alias("unit")
    )
    found = units.join(names, "unit", "left").groupBy("key", "digest").agg(
        F.max(F.when(F.col("unit") == F.col("digest"), F.col("name"))).alias("licence"),
        F.sort_array(F.collect_set("name")).alias("notices"),
    )
    return found.withColumnRenamed("key", id_col)
