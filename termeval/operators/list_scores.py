"""Precision, recall and F-score of lists that come as rows.

``predicted`` and ``relevant`` have rows ``(row_id, item)``. No list is ever
collected: one row may own any share of all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.functions.lists import f_score_of, ratio


def list_counts(
    predicted: DataFrame, relevant: DataFrame, rows: DataFrame, relevant_is_set: bool = False
) -> DataFrame:
    """``(row_id, n_predicted, n_relevant, n_hits)`` for every row of ``rows``.

    The two lists and the rows themselves are stacked and counted per
    ``(row_id, item)``, then per ``row_id``; there is no join. Counts combine
    before each shuffle, so a row with very many items, or an item with very many
    repeats, stays spread out. With ``relevant_is_set`` repeated relevant items
    count once.
    """

    def marked(df, item, mark):
        marks = ("is_predicted", "is_relevant", "is_row")
        return df.select("row_id", item, *(F.lit(int(m == mark)).alias(m) for m in marks))

    no_item = F.lit(None).cast(predicted.schema["item"].dataType).alias("item")
    stacked = (
        marked(predicted, "item", "is_predicted")
        .unionByName(marked(relevant, "item", "is_relevant"))
        .unionByName(marked(rows, no_item, "is_row"))
    )
    count_relevant = F.max if relevant_is_set else F.sum
    per_item = stacked.groupBy("row_id", "item").agg(
        F.sum("is_predicted").alias("n_predicted"),
        count_relevant("is_relevant").cast("bigint").alias("n_relevant"),
        F.max("is_row").alias("is_row"),
    )
    # A NULL item equals nothing: it counts in its list but is never a hit.
    hit = (F.col("n_relevant") > 0) & F.col("item").isNotNull()
    return (
        per_item.groupBy("row_id")
        .agg(
            F.sum("n_predicted").alias("n_predicted"),
            F.sum("n_relevant").alias("n_relevant"),
            F.sum(F.when(hit, F.col("n_predicted")).otherwise(0)).alias("n_hits"),
            F.max("is_row").alias("is_row"),
        )
        .filter(F.col("is_row") == 1)
        .drop("is_row")
    )


def list_scores(
    predicted: DataFrame,
    relevant: DataFrame,
    rows: DataFrame,
    beta: float = 1.0,
    on_undefined: str = "null",
    relevant_is_set: bool = False,
) -> DataFrame:
    """``(row_id, precision, recall, f_score)`` for every row of ``rows``.

    ``rows`` (unique ``row_id``) says which lists there are, as a list without
    items has no item rows.
    """
    counted = list_counts(predicted, relevant, rows, relevant_is_set)
    p = ratio(F.col("n_hits"), F.col("n_predicted"), on_undefined)
    r = ratio(F.col("n_hits"), F.col("n_relevant"), on_undefined)
    return counted.select(
        "row_id",
        p.alias("precision"),
        r.alias("recall"),
        f_score_of(p, r, beta, on_undefined).alias("f_score"),
    )


def named_list_precision(
    items: DataFrame, pairs: DataFrame, rows: DataFrame, on_undefined: str = "null"
) -> DataFrame:
    """``(row_id, value)``: share of each row's items found among ``pairs``.

    ``items`` has rows ``(row_id, seed_key, target_key)`` and ``pairs`` the
    distinct relevant ``(seed_key, target_key)``. Repeats are counted together
    before the join, so equal items meet the pairs once per row.
    """
    counted = items.groupBy("row_id", "seed_key", "target_key").agg(
        F.count("*").alias("n_items")
    )
    marked = counted.join(
        pairs.withColumn("is_hit", F.lit(1)), ["seed_key", "target_key"], "left"
    )
    scored = marked.groupBy("row_id").agg(
        F.sum("n_items").alias("n_predicted"),
        F.sum(F.when(F.col("is_hit") == 1, F.col("n_items")).otherwise(0)).alias("n_hits"),
    )
    return (
        rows.select("row_id")
        .join(scored, "row_id", "left")
        .na.fill(0, ["n_predicted", "n_hits"])
        .select(
            "row_id",
            ratio(F.col("n_hits"), F.col("n_predicted"), on_undefined).alias("value"),
        )
    )
