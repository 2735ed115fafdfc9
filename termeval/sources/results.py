"""The result log: long-form scores, and the nested result document.

Scores are appended as parquet, partitioned by experiment and run. A run's own
partitions are overwritten, so an append that is repeated, or was broken off and
is done again, leaves each score once. The metadata of a run is written last, and
only runs with metadata are read back, so a run that failed half-way is not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termeval.durable import scratch
from termeval.plans.evaluation import RUN_SCHEMA, Experiment

DOCUMENT_SCHEMA = (
    "Experiment string, Description string, Time double, "
    "Results array<map<string, struct<metric_descriptions: array<string>, "
    "results: array<map<string, double>>>>>"
)


class ResultLog:
    """An append-only log of experiment runs in one folder.

    ``row_id_type`` is the type of the row ids of the evaluation sets in it.
    """

    def __init__(self, spark: SparkSession, path: str, row_id_type: str = "bigint"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = (
            f"pipeline string, row_id {row_id_type}, metric string, value double, "
            "experiment string, run_id string"
        )

    def append(self, experiment: Experiment, scores: DataFrame) -> None:
        """Store the scores of one run of ``experiment``; doing so again changes nothing."""
        (
            scores.select(
                F.lit(experiment.name).alias("experiment"),
                F.lit(experiment.run_id).alias("run_id"),
                "pipeline",
                "row_id",
                "metric",
                "value",
            )
            .to(T.StructType.fromDDL(self.schema))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("experiment", "run_id")
            .parquet(f"{self.path}/scores")
        )
        metadata = experiment.metadata(self.spark).coalesce(1)
        heads = metadata.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        heads.partitionBy("run_id").parquet(f"{self.path}/runs")

    def record(self, experiment: Experiment, dataset: DataFrame) -> None:
        """Run ``experiment`` and store its scores; the tables it stores on the way are deleted."""
        with scratch(self.spark):
            self.append(experiment, experiment.run(dataset))

    def runs(self) -> DataFrame:
        # Run ids are texts, even if all of their letters are digits.
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/runs")

    def scores(self) -> DataFrame:
        """Scores of the completed runs."""
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/scores")
        completed = self.runs().select("run_id").distinct()
        return stored.join(completed, "run_id", "left_semi")

    def write_document(self, path: str) -> None:
        """Write the scores of all runs as JSON, one scored row a line, for :func:`read_document`."""
        heads = self.runs().select("run_id", "time", "description", "pipeline", "metric", "metric_description")
        scored = self.scores().join(heads, ["run_id", "pipeline", "metric"])
        # NaN has no JSON form and is written as null.
        value = F.nanvl("value", F.lit(None).cast("double"))
        scored.withColumn("value", value).write.option("ignoreNullFields", "false").json(path)

    def write_nested_document(self, path: str) -> None:
        """Write the runs as one nested JSON document, split over ordered part files.

        The part files in name order, put together, are the document.
        """
        document_lines(self.scores(), self.runs()).write.text(path)


def document_lines(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """The nested document of all runs as globally ordered lines of ``value``.

    Each row of an evaluation set is one line, so no run, pipeline or document
    is ever gathered in one place.
    """
    order = ["time", "run_id", "pipeline_position", "section", "row_id"]
    no_row = F.lit(None).cast(scores.schema["row_id"].dataType).alias("row_id")
    run_keys = ["time", "run_id", "experiment", "description"]

    pipelines = runs.groupBy(*run_keys, "pipeline_position", "pipeline").agg(
        F.array_sort(
            F.collect_list(F.struct("metric_position", "metric", "metric_description"))
        ).alias("metrics")
    )
    bounds = runs.groupBy(*run_keys).agg(
        F.min("pipeline_position").alias("first_position"),
        F.max("pipeline_position").alias("last_position"),
    )
    first_run = runs.agg(F.min(F.struct("time", "run_id")).alias("first")).select("first.run_id")
    is_first_run = F.col("first_run_id").isNotNull()
    run_heads = bounds.join(
        first_run.withColumnRenamed("run_id", "first_run_id"),
        F.col("run_id") == F.col("first_run_id"),
        "left",
    ).select(
        "time",
        "run_id",
        F.lit(-1).alias("pipeline_position"),
        F.lit(0).alias("section"),
        no_row,
        F.concat(
            F.when(is_first_run, "[").otherwise(","),
            F.lit('{"Experiment": '), _json_text("experiment"),
            F.lit(', "Description": '), _json_text("description"),
            F.lit(', "Time": '), F.col("time").cast("string"),
            F.lit(', "Results": ['),
        ).alias("value"),
    )

    descriptions = F.transform("metrics", lambda m: m["metric_description"])
    heads = pipelines.join(bounds.select("run_id", "first_position"), "run_id").select(
        "time",
        "run_id",
        "pipeline_position",
        F.lit(1).alias("section"),
        no_row,
        F.concat(
            F.when(F.col("pipeline_position") > F.col("first_position"), ",").otherwise(""),
            F.lit("{"), _json_text("pipeline"),
            F.lit(': {"metric_descriptions": '), F.to_json(descriptions),
            F.lit(', "results": ['),
        ).alias("value"),
    )
    tails = pipelines.select(
        "time", "run_id", "pipeline_position", F.lit(3).alias("section"), no_row,
        F.lit("]}}").alias("value"),
    )
    run_tails = bounds.select(
        "time", "run_id", (F.col("last_position") + 1).alias("pipeline_position"),
        F.lit(4).alias("section"), no_row, F.lit("]}").alias("value"),
    )
    end = runs.agg(F.max(F.struct("time", "run_id")).alias("last")).select(
        F.col("last.time").alias("time"),
        F.col("last.run_id").alias("run_id"),
        F.lit(2147483647).alias("pipeline_position"),
        F.lit(5).alias("section"),
        no_row,
        F.lit("]").alias("value"),
    )
    rows = _row_lines(scores, runs)
    lines = rows.unionByName(run_heads).unionByName(heads).unionByName(tails)
    return lines.unionByName(run_tails).unionByName(end).orderBy(*order).select("value")


def _row_lines(scores: DataFrame, runs: DataFrame) -> DataFrame:
    positions = runs.select(
        "run_id", "time", "pipeline", "pipeline_position", "metric", "metric_position"
    )
    first_rows = scores.groupBy("run_id", "pipeline").agg(F.min("row_id").alias("first_row"))
    # As many entries as metrics; NaN has no JSON form and is written as null.
    value = F.nanvl("value", F.lit(None).cast("double"))
    entries = F.array_sort(F.collect_list(F.struct("metric_position", "metric", value.alias("value"))))
    return (
        scores.join(positions, ["run_id", "pipeline", "metric"])
        .groupBy("time", "run_id", "pipeline", "pipeline_position", "row_id")
        .agg(entries.alias("entries"))
        .join(first_rows, ["run_id", "pipeline"])
        .select(
            "time",
            "run_id",
            "pipeline_position",
            F.lit(2).alias("section"),
            "row_id",
            F.concat(
                F.when(F.col("row_id") > F.col("first_row"), ",").otherwise(""),
                F.to_json(
                    F.map_from_entries(
                        F.transform("entries", lambda e: F.struct(e["metric"], e["value"]))
                    )
                ),
            ).alias("value"),
        )
    )


def _json_text(name: str) -> Column:
    """A string column as a JSON string."""
    wrapped = F.to_json(F.array(name))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def read_document(spark: SparkSession, path: str, row_id_type: str = "bigint") -> DataFrame:
    """Scores of documents that :meth:`ResultLog.write_document` wrote, with their runs.

    Files are split between tasks; a line that is no scored row fails.
    """
    schema = (
        "run_id string, experiment string, description string, time double, pipeline string, "
        f"row_id {row_id_type}, metric string, metric_description string, value double"
    )
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_nested_document(spark: SparkSession, path: str) -> DataFrame:
    """Scores of an existing nested result document, in long form.

    ``row_id`` is the position of the row within its pipeline's results. A file
    that is no whole document, such as one of several part files, fails.
    """
    document = spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    return (
        document.select(
            F.col("Experiment").alias("experiment"),
            F.col("Time").alias("time"),
            F.explode("Results").alias("result"),
        )
        .select("experiment", "time", F.explode("result").alias("pipeline", "outcome"))
        .select("experiment", "time", "pipeline", F.posexplode("outcome.results").alias("row_id", "row"))
        .select(
            "experiment",
            "time",
            "pipeline",
            F.col("row_id").cast("bigint").alias("row_id"),
            F.explode("row").alias("metric", "value"),
        )
    )
