"""The vocabulary: five tables with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "concept": _schema(
        concept_id=T.LongType(),
        concept_name=T.StringType(),
        vocabulary_id=T.StringType(),
        concept_code=T.StringType(),
        standard_concept=T.StringType(),
    ),
    "concept_synonym": _schema(
        concept_id=T.LongType(),
        concept_synonym_name=T.StringType(),
        language_concept_id=T.LongType(),
    ),
    "concept_relationship": _schema(
        concept_id_1=T.LongType(),
        concept_id_2=T.LongType(),
        relationship_id=T.StringType(),
        valid_start_date=T.DateType(),
        valid_end_date=T.DateType(),
        invalid_reason=T.StringType(),
    ),
    "concept_ancestor": _schema(
        ancestor_concept_id=T.LongType(),
        descendant_concept_id=T.LongType(),
        min_levels_of_separation=T.IntegerType(),
        max_levels_of_separation=T.IntegerType(),
    ),
    "concept_embedding": _schema(
        concept_id=T.LongType(), embedding=T.ArrayType(T.FloatType())
    ),
}

CONCEPT_COLUMNS = SCHEMAS["concept"].fieldNames()


def conform(df: DataFrame, table: str) -> DataFrame:
    """The fixed columns of ``table``, cast where a source declares another type."""
    schema = SCHEMAS[table]
    missing = [name for name in schema.fieldNames() if name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    columns = []
    for field in schema:
        column = F.col(field.name)
        if df.schema[field.name].dataType != field.dataType:
            column = column.cast(field.dataType).alias(field.name)
        columns.append(column)
    return df.select(*columns)


class Vocabulary:
    """The vocabulary tables, each opened when first used.

    ``open_table`` maps a table name to its DataFrame. Only
    ``concept.concept_id`` is unique.
    """

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open = open_table

    def _table(self, name: str) -> DataFrame:
        return conform(self._open(name), name)

    @cached_property
    def concept(self) -> DataFrame:
        return self._table("concept")

    @cached_property
    def concept_synonym(self) -> DataFrame:
        return self._table("concept_synonym")

    @cached_property
    def concept_relationship(self) -> DataFrame:
        return self._table("concept_relationship")

    @cached_property
    def concept_ancestor(self) -> DataFrame:
        return self._table("concept_ancestor")

    @cached_property
    def concept_embedding(self) -> DataFrame:
        return self._table("concept_embedding")

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Vocabulary:
        return cls(tables.__getitem__)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Vocabulary:
        """Read ``<folder>/<table>``; ``{table}`` in ``folder`` places the name."""
        pattern = folder if "{table}" in folder else f"{folder.rstrip('/')}/{{table}}"
        return cls(lambda table: spark.read.parquet(pattern.format(table=table)))

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, schema: str, embedding_table: str = "concept_embedding"
    ) -> Vocabulary:
        """Read catalog tables of one schema."""
        names = {"concept_embedding": embedding_table}
        return cls(lambda table: spark.table(f"{schema}.{names.get(table, table)}"))

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        schema: str,
        options: Mapping[str, str],
        partitioning: Mapping[str, tuple[str, int, int, int]] | None = None,
        embedding_table: str = "concept_embedding",
    ) -> Vocabulary:
        """Read the tables over JDBC.

        ``partitioning`` gives ``(column, lower, upper, partitions)`` per table,
        so that large tables are read in parallel ranges. Vectors must arrive as
        an array type.
        """
        names = {"concept_embedding": embedding_table}

        def open_table(table: str) -> DataFrame:
            reader = spark.read.format("jdbc").option("url", url).options(**options)
            reader = reader.option("dbtable", f"{schema}.{names.get(table, table)}")
            if partitioning and table in partitioning:
                column, lower, upper, partitions = partitioning[table]
                reader = reader.options(
                    partitionColumn=column,
                    lowerBound=lower,
                    upperBound=upper,
                    numPartitions=partitions,
                )
            return reader.load()

        return cls(open_table)
