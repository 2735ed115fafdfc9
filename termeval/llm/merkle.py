"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of text.

A section ends with a blank line, a paragraph with a line break, a piece after
a sentence or four words. Every node's digest covers the text below it, so
equal roots mean equal texts and branches that differ lead to the edits. Pieces
are cut by content: soon after an edit the cuts fall as before.

Only DataFrame functions; a text is never compared with more than one other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to four words, ending early after a sentence mark; a run without white
# space is cut after 64 characters. Each character is in exactly one piece.
PIECE = r"\s*+\S{1,64}+(?:(?<![.!?])\s++\S{1,64}+){0,3}+\s*+|\s++"
SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)"
# Neighbours are found inside ranges of ids; so many ranges for each shuffle partition.
RANGES_PER_PARTITION = 4


def tree(text: Column) -> Column:
    """The tree of ``text``: ``array<array<struct<node string, pieces array<int>>>>``.

    The outer array holds sections, the inner their paragraphs; ``node`` is 32
    digits of the paragraph's SHA-256, ``pieces`` 24 bits of each piece's hash.
    A null text is an empty one: one section of one empty paragraph.
    """

    def paragraph(p: Column) -> Column:
        pieces = F.transform(
            F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)),
            lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFF)).cast("int"),
        )
        return F.struct(F.substring(F.sha2(p, 256), 1, 32).alias("node"), pieces.alias("pieces"))

    sections = F.split(F.coalesce(text, F.lit("")), SECTION_END, -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, PARAGRAPH_END, -1), paragraph))


def root(branches: Column) -> Column:
    """The digest of the sections' digests, each made from its paragraphs' nodes."""

    def section(s: Column) -> Column:
        return F.sha2(F.array_join(F.transform(s, lambda p: p["node"]), ","), 256)

    return F.sha2(F.array_join(F.transform(branches, section), ","), 256)


def serialised(branches: Column) -> Column:
    """The tree as one string: ``root/section;section``.

    A section is its paragraphs joined by commas, a paragraph its node, a colon
    and six digits for each piece.
    """

    def paragraph(p: Column) -> Column:
        digits = F.transform(p["pieces"], lambda v: F.lpad(F.lower(F.hex(v)), 6, "0"))
        return F.concat(p["node"], F.lit(":"), F.array_join(digits, ""))

    sections = F.transform(branches, lambda s: F.array_join(F.transform(s, paragraph), ","))
    return F.concat(root(branches), F.lit("/"), F.array_join(sections, ";"))


def pieces(branches: Column) -> Column:
    """The distinct pieces of a whole tree."""
    return F.array_distinct(F.flatten(F.transform(F.flatten(branches), lambda p: p["pieces"])))


def likeness(one: Column, other: Column) -> Column:
    """Of two columns of ``pieces``: twice the shared ones as a part of all of both."""
    shared = F.size(F.array_intersect(one, other))
    both = F.size(one) + F.size(other)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``tree`` and ``fingerprint`` of every text.

    Null and empty texts share the fingerprint of the empty text. Repeated rows
    come out as often as they went in; other columns are left out.
    """
    trees = df.select(F.col(id_col), tree(F.col(text_col)).alias("tree"))
    return trees.withColumn("fingerprint", serialised(F.col("tree")))


def changed(df: DataFrame, one: str, other: str) -> DataFrame:
    """Where two trees of each row differ: the columns of ``df``, ``section``, ``paragraph``.

    Both columns hold trees; the places count from 0. Equal roots have no row,
    and sections with equal digests are not looked into. Sections or paragraphs
    that only one tree has differ.
    """

    def unequal(a: Column, b: Column) -> Column:
        both = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
        return F.filter(both, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))

    def nodes(branches: Column) -> Column:
        return F.transform(branches, lambda s: F.transform(s, lambda p: p["node"]))

    rows = df.where(root(F.col(one)) != root(F.col(other))).withColumns(
        {"_one": nodes(F.col(one)), "_other": nodes(F.col(other))}
    )
    rows = rows.withColumn("section", F.explode(unequal(F.col("_one"), F.col("_other"))))
    empty = F.array().cast("array<string>")
    mine = F.coalesce(F.get("_one", F.col("section")), empty)
    theirs = F.coalesce(F.get("_other", F.col("section")), empty)
    return rows.withColumn("paragraph", F.explode(unequal(mine, theirs))).drop("_one", "_other")


def _ranges(keys: DataFrame) -> list:
    """Least keys of about equally full ranges of the column ``key``, as many as partitions ask for."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = partitions * RANGES_PER_PARTITION
    found = keys.agg(
        F.min("key").alias("least"),
        F.percentile_approx("key", [i / count for i in range(1, count)], 20 * count).alias("cuts"),
    ).first()
    return [] if found.least is None else sorted({found.least, *found.cuts})


def _range_of(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, in about two square roots of steps."""
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut <= key))

    group = at_most(F.array(*(F.lit(g[0]) for g in groups)))
    own = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    return (group - 1) * width + at_most(F.element_at(own, F.greatest(group, F.lit(1))))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``text``, ``range``, ``after`` and ``next_text``, by ascending integer ids.

    Rows are dealt by ranges of ids. The first row of a range also goes to the
    range before it, marked ``after``, so each range knows what follows its last
    row; the first of all follows the last. Equal ids are ordered by text, nulls
    first.
    """
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(F.col("key").isNotNull())
    cuts = _ranges(rows.select("key")) or [0]
    own = _range_of(F.col("key"), cuts) - 1
    first = F.col("key").isin(cuts) if len(cuts) < 100 else F.array_contains(F.lit(cuts), F.col("key"))
    before = F.pmod(own - 1, F.lit(len(cuts)))
    places = F.when(
        first,
        F.array(
            F.struct(own.alias("range"), F.lit(False).alias("after")),
            F.struct(before.alias("range"), F.lit(True).alias("after")),
        ),
    ).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("after"))))
    dealt = rows.withColumn("place", F.explode(places)).select("key", "text", "place.*")
    return dealt.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(_in_range()))


def _in_range():
    return Window.partitionBy("range").orderBy("after", "key", "text")


def edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of an edited form, and how like they are.

    The edited text has its last quarter of code points (rounded down) replaced
    by the first as many of the next document's, or all it has. Columns: ``id_col``,
    ``n_chars long``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Null texts count as empty. A row without an id
    has no next document: its last quarter is cut off and ``near_next`` is null.
    """
    rows = with_next(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lone = df.where(F.col(id_col).isNull()).select(
        F.col(id_col).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit(None).cast("int").alias("range"),
        F.lit(False).alias("after"),
        F.lit("").alias("next_text"),
    )

    def judged(rows: DataFrame, near_next: Column) -> DataFrame:
        quarter = F.floor(F.length("text") / 4).cast("int")
        edited = F.concat(
            F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)
        )
        rows = rows.withColumns({"edited": edited, "tree": tree(F.col("text"))})
        rows = rows.withColumns({"edited_tree": tree(F.col("edited")), "pieces": pieces(F.col("tree"))})
        rows = rows.withColumn("near_next", near_next).where(~F.col("after"))
        return rows.select(
            F.col("key").alias(id_col),
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            serialised(F.col("tree")).alias("fingerprint"),
            serialised(F.col("edited_tree")).alias("edited_fingerprint"),
            likeness(F.col("pieces"), pieces(F.col("edited_tree"))).alias("near_edited"),
            "near_next",
        )

    following = F.lead("pieces").over(_in_range())
    found = judged(rows, likeness(F.col("pieces"), following))
    return found.unionByName(judged(lone, F.lit(None).cast("double")))
