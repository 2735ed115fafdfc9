"""Evaluation sets: ``(row_id, input_data, expected_output)`` in one row.

Any callable that returns a DataFrame with these columns serves as a source; the
functions here cover CSV files, parquet folders and catalog tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termeval.durable import materialise

REQUIRED = ("input_data", "expected_output")


def as_pairs(df: DataFrame, key: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Select and check the columns of an evaluation set.

    ``key`` names a unique column to identify rows. Without one, rows are
    numbered from 0 without gaps: those of files by the names of the files and
    their order in them, others in the order in which they came. The numbers are
    given once and stored, as plans that join a set to itself would go wrong if a
    second reading numbered the rows differently.
    """
    wanted = [*REQUIRED, *extra, *([key] if key else [])]
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"the evaluation set lacks the columns {', '.join(missing)}")
    columns = [*(_text(c) for c in REQUIRED), *(F.col(c) for c in extra)]
    if key:
        return df.select(F.col(key).alias("row_id"), *columns)
    try:
        placed = df.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), *columns)
    except AnalysisException:
        # Rows that come from no file, or not straight from one.
        placed = df.select(F.lit("").alias("file_path"), F.spark_partition_id().alias("file_block_start"), *columns)
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    """``row_id`` for rows with the file and the block they were read from.

    Rows of one block are read one after the other in one task. The number of a
    row is that of all rows in blocks before its own, and its place in the
    block; only one count for each block comes to the driver.
    """
    spark = placed.sparkSession
    columns = placed.columns[2:]
    stored = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "pairs")
    blocks = stored.groupBy("file_path", "file_block_start").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    before, offsets = 0, []
    for block in sorted(blocks.collect()):
        offsets.append((block.file_path, block.file_block_start, before - block.first))
        before += block.n
    kind = stored.schema["file_block_start"].dataType.simpleString()
    known = spark.createDataFrame(offsets, f"file_path string, file_block_start {kind}, offset long")
    # One row for each block: a task's input, not a row of the set.
    numbered = stored.join(F.broadcast(known), ["file_path", "file_block_start"])
    return numbered.select((F.col("_at") + F.col("offset")).alias("row_id"), *columns)


def read_csv_pairs(
    spark: SparkSession, path: str, key: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Evaluation pairs of CSV files with a header; other columns are ignored.

    All values are text and empty cells are NULL. Files are split between tasks
    unless a cell holds a line break, ``multi_line``; by default that is looked
    up: a cell that goes on in the next line leaves a line with an odd number of
    quotes behind.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    df = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False
    )
    return as_pairs(df, key)


def read_csv_prompt_pairs(
    spark: SparkSession, path: str, key: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """As :func:`read_csv_pairs` with the input wrapped in a one-element array."""
    return wrap_input(read_csv_pairs(spark, path, key, multi_line))


def wrap_input(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("input_data", F.array("input_data"))


def read_parquet_pairs(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return as_pairs(spark.read.parquet(path), key)


def read_table_pairs(spark: SparkSession, table: str, key: str | None = None) -> DataFrame:
    return as_pairs(spark.table(table), key)


def _text(name: str) -> Column:
    column = F.col(name).cast("string")
    return F.when(column != "", column).alias(name)
