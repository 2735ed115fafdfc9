"""Vocabulary tables and evaluation sets derived from the driver's tables.

Everything is derived from whole tables by projections, unique-key joins and
aggregates, so its size grows in step with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termeval.sources.vocabulary import Vocabulary

# Concept ids are key * 8 + kind: unique however large the tables grow.
PART, REGION, NATION, CUSTOMER, SUPPLIER = range(5)

# The vocabularies used where a query restricts its seed concepts.
BRANDS = ["Brand#13", "Brand#5"]


def concept_key(key: str, kind: int) -> Column:
    return (F.col(key).cast("bigint") * 8 + kind).cast("bigint")


# Schemas of the tables seen so far; knowing one saves a job that reads footers.
SCHEMAS: dict[str, StructType] = {}


def once(derive: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Derive a view once per :class:`Tables`."""

    @wraps(derive)
    def view(t: Tables) -> DataFrame:
        if derive.__name__ not in t.views:
            t.views[derive.__name__] = derive(t)
        return t.views[derive.__name__]

    return view


class Tables:
    """The driver's tables, each opened once, when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.views: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        reader = self.spark.read
        if path in SCHEMAS:
            reader = reader.schema(SCHEMAS[path])
        table = reader.parquet(path)
        SCHEMAS[path] = table.schema
        setattr(self, name, table)
        return table


@once
def concept(t: Tables) -> DataFrame:
    def rows(df, key, kind, name, vocabulary, code, standard):
        return df.select(
            concept_key(key, kind).alias("concept_id"),
            F.col(name).alias("concept_name"),
            vocabulary.alias("vocabulary_id"),
            code.cast("string").alias("concept_code"),
            standard.alias("standard_concept"),
        )

    standard, not_standard = F.lit("S"), F.lit(None).cast("string")
    part_standard = F.when(F.col("p_size") % 5 != 0, "S")
    return (
        rows(t.part, "p_partkey", PART, "p_name", F.col("p_brand"), F.col("p_type"), part_standard)
        .unionByName(
            rows(t.region, "r_regionkey", REGION, "r_name", F.lit("Region"), F.col("r_regionkey"), standard)
        )
        .unionByName(
            rows(t.nation, "n_nationkey", NATION, "n_name", F.lit("Nation"), F.col("n_nationkey"), standard)
        )
        .unionByName(
            rows(t.customer, "c_custkey", CUSTOMER, "c_name", F.lit("Customer"), F.col("c_mktsegment"), not_standard)
        )
        .unionByName(
            rows(t.supplier, "s_suppkey", SUPPLIER, "s_name", F.lit("Supplier"), F.col("s_nationkey"), standard)
        )
    )


def concept_synonym(t: Tables) -> DataFrame:
    """One synonym per part, a second one for large parts."""
    kind_first = F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name"))
    brand_last = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_brand"))
    names = F.array(kind_first, F.when(F.col("p_size") > 25, brand_last))
    return (
        t.part.select(concept_key("p_partkey", PART).alias("concept_id"), F.explode(names).alias("name"))
        .filter(F.col("name").isNotNull())
        .select(
            "concept_id",
            F.col("name").alias("concept_synonym_name"),
            F.lit(4180186).cast("bigint").alias("language_concept_id"),
        )
    )


def concept_relationship(t: Tables) -> DataFrame:
    """Each line item relates its part to its supplier, both ways."""
    part, supplier = concept_key("l_partkey", PART), concept_key("l_suppkey", SUPPLIER)
    ways = F.array(
        F.struct(part.alias("a"), supplier.alias("b"), F.lit("Supplied by").alias("kind")),
        F.struct(supplier.alias("a"), part.alias("b"), F.lit("Supplies").alias("kind")),
    )
    shipped = F.col("l_shipdate").cast("date")
    return t.lineitem.select(
        F.explode(ways).alias("way"),
        shipped.alias("valid_start_date"),
        shipped.alias("valid_end_date"),
        F.when(F.col("l_returnflag") == "R", "D").alias("invalid_reason"),
    ).select(
        F.col("way.a").alias("concept_id_1"),
        F.col("way.b").alias("concept_id_2"),
        F.col("way.kind").alias("relationship_id"),
        "valid_start_date",
        "valid_end_date",
        "invalid_reason",
    )


def concept_ancestor(t: Tables) -> DataFrame:
    """The closure region > nation > customer, supplier, with self rows.

    The two levels differ for customers with an odd key.
    """

    def rows(df, ancestor, descendant, least, most):
        return df.select(
            ancestor.alias("ancestor_concept_id"),
            descendant.alias("descendant_concept_id"),
            F.lit(least).cast("int").alias("min_levels_of_separation"),
            most.cast("int").alias("max_levels_of_separation"),
        )

    region = concept_key("n_regionkey", REGION)
    customer, supplier = concept_key("c_custkey", CUSTOMER), concept_key("s_suppkey", SUPPLIER)
    located_customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    located_suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    self_rows = concept(t).filter(~F.col("vocabulary_id").startswith("Brand"))
    return (
        rows(t.nation, region, concept_key("n_nationkey", NATION), 1, F.lit(1))
        .unionByName(rows(t.customer, concept_key("c_nationkey", NATION), customer, 1, F.lit(1)))
        .unionByName(rows(t.supplier, concept_key("s_nationkey", NATION), supplier, 1, F.lit(1)))
        .unionByName(rows(located_customers, region, customer, 2, 2 + F.col("c_custkey") % 2))
        .unionByName(rows(located_suppliers, region, supplier, 2, F.lit(2)))
        .unionByName(rows(self_rows, F.col("concept_id"), F.col("concept_id"), 0, F.lit(0)))
    )


@once
def concept_embedding(t: Tables) -> DataFrame:
    return t.embeddings.select(concept_key("vec_id", PART).alias("concept_id"), "embedding")


def vocabulary(t: Tables) -> Vocabulary:
    views = (concept, concept_synonym, concept_relationship, concept_ancestor, concept_embedding)
    derive = {view.__name__: view for view in views}
    return Vocabulary(lambda table: derive[table](t))


def name_seeds(t: Tables) -> DataFrame:
    """Every distinct concept name, upper-cased: ``(query_id, name)``."""
    return (
        concept(t)
        .select(F.lower("concept_name").alias("query_id"))
        .distinct()
        .select("query_id", F.upper("query_id").alias("name"))
    )


def id_seeds(t: Tables) -> DataFrame:
    """Every concept id asks about itself: ``(query_id, concept_id)``."""
    return concept(t).select(F.col("concept_id").alias("query_id"), "concept_id")


def name_searches(t: Tables) -> DataFrame:
    """Every distinct part name as a search: ``(query_id, search_term)``."""
    return (
        t.part.select(F.col("p_name").alias("query_id"))
        .distinct()
        .select("query_id", F.concat(F.lit("the "), F.col("query_id")).alias("search_term"))
    )


def clause_searches(t: Tables) -> DataFrame:
    """Every distinct part name and type: one of the first word or the type, and one of the last word or "bolt"."""
    words = F.split("p_name", " ")
    kind = F.lower("p_type")
    return (
        t.part.select("p_name", "p_type")
        .distinct()
        .select(
            F.concat("p_name", F.lit(" "), kind).alias("query_id"),
            F.array(
                F.array_distinct(F.array(F.element_at(words, 1), kind)),
                F.array_distinct(F.array(F.element_at(words, -1), F.lit("bolt"))),
            ).alias("clauses"),
        )
    )


def lookup_searches(t: Tables) -> DataFrame:
    """Every distinct part name and type as a search; most types match nothing."""
    kinds = t.part.select(F.col("p_type").alias("query_id")).distinct()
    kinds = kinds.select("query_id", F.concat(F.lit("the "), F.lower("query_id")).alias("search_term"))
    return name_searches(t).unionByName(kinds)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """``(key, vector)``: mean of ``embedding`` per key, rounded to 9 places.

    Elements are averaged per key and position, combined before the shuffle.
    """
    positions = vectors.select(key, F.posexplode("embedding").alias("position", "x"))
    means = positions.groupBy(key, "position").agg(
        F.round(F.avg(F.col("x").cast("double")), 9).alias("x")
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda e: e["x"]).alias("vector"))


@once
def name_vectors(t: Tables) -> DataFrame:
    """``(text, vector)``: the mean vector of the concepts of each name."""
    named = concept(t).join(concept_embedding(t), "concept_id")
    return mean_vectors(named.select(F.lower("concept_name").alias("text"), "embedding"), "text")


def label_vectors(t: Tables) -> DataFrame:
    """``(query_id, vector)``: the mean vector of each label."""
    return mean_vectors(t.embeddings.withColumnRenamed("label", "query_id"), "query_id")


def naming_set(t: Tables) -> DataFrame:
    """Find a name from a vector: one row per concept that has a vector."""
    name = F.lower("concept_name")
    return concept(t).join(concept_embedding(t), "concept_id").select(
        F.col("concept_id").alias("row_id"),
        name.alias("input_data"),
        F.upper("concept_name").alias("expected_output"),
        F.array(name).alias("relevant"),
        F.col("embedding").alias("vector"),
    )


@once
def eval_pairs(t: Tables) -> DataFrame:
    """Padded upper-case, equal and different predictions for part names."""
    n_parts = t.part.count()
    other = t.part.select(F.col("p_partkey").alias("other_key"), F.col("p_name").alias("input_data"))
    turn = F.col("p_partkey") % 4
    return t.part.join(other, F.col("other_key") == (F.col("p_partkey") * 7 + 3) % n_parts).select(
        F.col("p_partkey").alias("row_id"),
        "input_data",
        F.col("p_name").alias("expected_output"),
        F.when(turn == 0, F.concat(F.lit(" "), F.upper("p_name")))
        .when(turn == 1, F.col("p_name"))
        .otherwise(F.col("input_data"))
        .alias("prediction"),
    )


def eval_related(t: Tables) -> DataFrame:
    """Predictions for part names: equal, another part's name, a supplier's name."""
    n_suppliers = t.supplier.count()
    suppliers = t.supplier.select("s_suppkey", "s_name")
    turn = F.col("row_id") % 4
    return (
        eval_pairs(t)
        .join(suppliers, F.col("s_suppkey") == (F.col("row_id") * 7 + 3) % n_suppliers)
        .select(
            "row_id",
            "expected_output",
            F.when(turn > 1, F.concat(F.upper("s_name"), F.lit("\t")))
            .otherwise(F.col("prediction"))
            .alias("prediction"),
        )
    )


def eval_hierarchy(t: Tables) -> DataFrame:
    """Self, region and nation predictions for customers."""
    turn = F.col("c_custkey") % 3
    nation = F.concat(F.lit(" Nation_"), (F.col("c_custkey") % 25).cast("string"))
    return t.customer.join(t.region, F.col("r_regionkey") == F.col("c_custkey") % 5).select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_name").alias("expected_output"),
        F.when(turn == 0, F.lower("c_name"))
        .when(turn == 1, F.lower("r_name"))
        .otherwise(nation)
        .alias("prediction"),
    )


def eval_descriptions(t: Tables) -> DataFrame:
    """A description of each supplier as expected, that of the next one as prediction."""
    n_suppliers = t.supplier.count()
    located = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    located = located.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.concat(F.col("n_name"), F.lit(", "), F.col("r_name"))
    told = F.concat(
        F.col("s_name"), F.lit(" delivers all goods from "), place, F.lit(" to buyers outside "), F.upper("n_name"), F.lit(". "), place
    )
    told = located.select("s_suppkey", told.alias("told"))
    other = told.select(((F.col("s_suppkey") + 1) % n_suppliers).alias("row_id"), F.col("told").alias("prediction"))
    return other.join(told.withColumnRenamed("s_suppkey", "row_id").withColumnRenamed("told", "expected_output"), "row_id")


def eval_turns(t: Tables) -> DataFrame:
    """A user turn and the assistant's reply to it, whole texts."""
    replies = t.conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    asked = t.conversations.filter(F.col("role") == "user")
    return asked.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("input_data"), "prediction"
    )


@once
def order_items(t: Tables) -> DataFrame:
    """``(row_id, item, l_quantity, l_returnflag)``: part names per order."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("row_id"),
        F.col("p_name").alias("item"),
        "l_quantity",
        "l_returnflag",
    )


def order_rows(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"))


def predicted_items(t: Tables) -> DataFrame:
    """Predicted names per order, repeats included: lines of over 20 pieces."""
    return order_items(t).filter(F.col("l_quantity") > 20).select("row_id", "item")


def relevant_items(t: Tables) -> DataFrame:
    """Relevant names per order, to be taken as a set: lines that were kept."""
    return order_items(t).filter(F.col("l_returnflag") != "R").select("row_id", "item")


def supplier_items(t: Tables) -> DataFrame:
    """``(row_id, name, item)``: the suppliers of an order, and a part's name."""
    n_parts = t.part.count()
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(t.part, F.col("p_partkey") == F.col("l_orderkey") % n_parts).select(
        F.col("l_orderkey").alias("row_id"), F.col("p_name").alias("name"), F.col("s_name").alias("item")
    )


def eval_places(t: Tables) -> DataFrame:
    """Predicted lists of four names for customers, some of them ancestors."""
    nation = t.nation.select("n_nationkey", "n_name")
    region = t.region.select("r_regionkey", "r_name")
    return (
        t.customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("c_custkey") % 5)
        .select(
            F.col("c_custkey").alias("row_id"),
            F.col("c_name").alias("expected_output"),
            F.array("n_name", "n_name", "r_name", F.lower("n_name")).alias("retrieved"),
        )
    )


def recorded_replies(t: Tables) -> DataFrame:
    """One recorded reply per distinct input: ``(input_data, reply)``."""
    return eval_pairs(t).groupBy("input_data").agg(F.min("prediction").alias("reply"))
