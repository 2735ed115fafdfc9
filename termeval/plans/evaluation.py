"""Evaluations, experiments and their summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.plans.metrics import Metric
from termeval.plans.pipelines import Pipeline

RUN_SCHEMA = (
    "run_id string, experiment string, description string, time double, "
    "pipeline_position int, pipeline string, metric_position int, metric string, "
    "metric_description string"
)


@dataclass
class Evaluation:
    """One pipeline scored by several metrics."""

    name: str
    pipeline: Pipeline
    metrics: Sequence[Metric]

    def __post_init__(self):
        labels = self.labels
        if len(set(labels)) < len(labels):
            raise ValueError(f"metric labels of {self.name} must differ: {labels}")

    @property
    def labels(self) -> list[str]:
        return [metric.label for metric in self.metrics]

    @property
    def metric_descriptions(self) -> list[str]:
        return [metric.description for metric in self.metrics]

    def wide(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with the prediction and one column per metric."""
        predicted = self.pipeline.transform(dataset)
        if self.pipeline.costly:
            predicted = materialise(predicted, "predictions")
        return reduce(lambda df, metric: metric.apply(df), self.metrics, predicted)

    def run(self, dataset: DataFrame) -> DataFrame:
        """``(pipeline, row_id, metric, value)``, one row per row and metric."""
        scores = self.wide(dataset).select(
            F.lit(self.name).alias("pipeline"),
            "row_id",
            *(F.col(label).cast("double").alias(label) for label in self.labels),
        )
        return scores.unpivot(["pipeline", "row_id"], self.labels, "metric", "value")


@dataclass
class Experiment:
    """Several evaluations over one dataset."""

    name: str
    evaluations: Sequence[Evaluation]
    description: str = ""
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    time: float = field(default_factory=time.time)

    def __post_init__(self):
        names = [evaluation.name for evaluation in self.evaluations]
        if len(set(names)) < len(names):
            raise ValueError(f"pipeline names must differ: {names}")

    def run(self, dataset: DataFrame) -> DataFrame:
        """The long-form scores of all evaluations.

        The dataset is stored first, so that all pipelines read the same rows and
        none derives them again.
        """
        if len(self.evaluations) > 1:
            dataset = materialise(dataset, "dataset")
        runs = [evaluation.run(dataset) for evaluation in self.evaluations]
        return reduce(DataFrame.unionByName, runs)

    def metadata(self, spark) -> DataFrame:
        """One row per pipeline and metric: positions, texts, run and time."""
        rows = [
            (self.run_id, self.name, self.description, self.time, i, e.name, j, m.label, m.description)
            for i, e in enumerate(self.evaluations)
            for j, m in enumerate(e.metrics)
        ]
        return spark.createDataFrame(rows, RUN_SCHEMA)


def summarise(scores: DataFrame) -> DataFrame:
    """Mean score, row count and undefined scores per pipeline and metric."""
    return scores.groupBy("pipeline", "metric").agg(
        F.avg("value").alias("mean_value"),
        F.count("*").alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_undefined"),
    )


def compare(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per pipeline with the mean of each metric in its own column."""
    return scores.groupBy("pipeline").pivot("metric", list(labels)).agg(F.avg("value"))
