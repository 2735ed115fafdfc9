"""Prediction pipelines: each adds a ``prediction`` column to an evaluation set."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.operators.vectors import nearest_concepts_batch
from termeval.sources.vocabulary import Vocabulary

PromptBuilder = Callable[[DataFrame], Column]


class Pipeline(ABC):
    """Adds predictions to the rows of an evaluation set, one per row.

    ``costly`` marks pipelines whose predictions are stored before scoring,
    because a second run could differ or is expensive.
    """

    costly = False

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column."""


class IdentityPipeline(Pipeline):
    """Predicts its own input."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col("input_data"))


class ColumnPipeline(Pipeline):
    """Predicts with a column expression."""

    def __init__(self, expression: Column):
        self.expression = expression

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.expression)


def replay(replies: DataFrame, on: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A predictor that looks up recorded replies by the columns ``on``.

    A key with two different replies fails the job; a row without a recorded
    reply gets NULL.
    """
    on = list(on)
    conflict = F.raise_error(F.lit("two different replies recorded for one key"))
    unique = replies.groupBy(*on).agg(
        F.when(F.min("reply").eqNullSafe(F.max("reply")), F.min("reply"))
        .otherwise(conflict)
        .alias("prediction")
    )
    return lambda df: df.join(unique, on, "left")


def model_predictor(
    load: Callable[[], Callable[[list[str]], list[str]]], column: str = "prompt"
) -> Callable[[DataFrame], DataFrame]:
    """A predictor that runs a user's model over the text in ``column``.

    ``load`` is called once per task in the Python worker and returns a function
    from a batch of texts to as many replies.
    """

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), dtype=object)

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", complete(F.col(column)))

    return predict


def vector_predictor(
    load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    width: int,
    column: str = "input_data",
) -> Callable[[DataFrame], DataFrame]:
    """A predictor that runs a user's encoder over the text in ``column``.

    ``load`` is called once per task in the Python worker and returns a function
    from a batch of texts to as many vectors of ``width`` numbers; anything else
    fails the job. Equal texts of a batch are encoded once. A NULL text has a
    NULL vector. Predictions are ``array<float>``.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = batch.dropna().unique().tolist()
            found = np.asarray(model(texts) if texts else np.zeros((0, width)), dtype=np.float32)
            if found.shape != (len(texts), width):
                raise ValueError(f"vectors of shape {found.shape} for {len(texts)} texts of width {width}")
            known = dict(zip(texts, found))
            yield pd.Series([known.get(text) for text in batch], dtype=object)

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", encode(F.col(column)))

    return predict


def one_vector(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` and the vector of each text as ``name``; two different vectors of a text fail the job."""
    conflict = F.raise_error(F.lit("two different vectors for one text"))
    vector = F.when(F.min("vector").eqNullSafe(F.max("vector")), F.min("vector")).otherwise(conflict)
    return vectors.groupBy(F.col("text").alias(column)).agg(vector.alias(name))


class EncoderPipeline(Pipeline):
    """Encodes each input text by a predictor of vectors; the prediction is the vector.

    With ``expected``, the expected outputs are encoded too, as the column
    ``expected_vector`` that vector metrics compare with.
    """

    def __init__(
        self,
        load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
        width: int,
        expected: bool = False,
        costly: bool = True,
    ):
        self.predictor = vector_predictor(load, width)
        self.expected = vector_predictor(load, width, "expected_output") if expected else None
        self.costly = costly

    def transform(self, df: DataFrame) -> DataFrame:
        if self.expected is not None:
            df = self.expected(df).withColumnRenamed("prediction", "expected_vector")
        return self.predictor(df)


class PromptPipeline(Pipeline):
    """Renders a prompt per row and lets a predictor answer it."""

    def __init__(
        self,
        predictor: Callable[[DataFrame], DataFrame],
        prompt: PromptBuilder | None = None,
        costly: bool = False,
    ):
        self.predictor = predictor
        self.prompt = prompt
        self.costly = costly

    def transform(self, df: DataFrame) -> DataFrame:
        if self.prompt is not None:
            df = df.withColumn("prompt", self.prompt(df))
        return self.predictor(df)


class EmbeddingPipeline(Pipeline):
    """Looks up the vector of each input text; the prediction is the vector.

    ``vectors`` has ``text`` and ``vector``. Inputs without a vector get NULL; a
    text with two different ones fails the job.
    """

    def __init__(self, vectors: DataFrame, column: str = "input_data"):
        self.vectors = vectors
        self.column = column

    def transform(self, df: DataFrame) -> DataFrame:
        known = one_vector(self.vectors, self.column, "prediction")
        return df.join(known, self.column, "left")


def document_lists(ranked: DataFrame, k: int) -> DataFrame:
    """``(query_id, documents)``: the first ``k`` ranked results, in order.

    The ranking already bounds the length of each list.
    """
    document = F.struct("rank", "content", "score")
    return (
        ranked.filter(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(document)).alias("documents"))
    )


def retrieve(df: DataFrame, vocab: Vocabulary, k: int) -> DataFrame:
    """Rank the ``k`` nearest concepts of each row's ``vector``."""
    queries = df.select(F.col("row_id").alias("query_id"), "vector")
    return nearest_concepts_batch(queries, vocab, k)


class RetrievalPipeline(Pipeline):
    """Retrieves concepts by vector, renders a prompt and predicts from it.

    Rows carry a ``vector``, or ``vectors`` ``(text, vector)`` supplies it. A
    ranking computed once for a larger ``k`` can be handed in as ``ranked``; its
    prefix is used; without one, predictions are stored before they are scored, so
    that no metric ranks again. Without a predictor, the nearest name is the
    prediction.
    """

    def __init__(
        self,
        vocab: Vocabulary,
        k: int = 5,
        predictor: Callable[[DataFrame], DataFrame] | None = None,
        prompt: PromptBuilder | None = None,
        vectors: DataFrame | None = None,
        ranked: DataFrame | None = None,
        costly: bool = False,
    ):
        self.vocab = vocab
        self.k = k
        self.predictor = predictor
        self.prompt = prompt
        self.vectors = vectors
        self.ranked = ranked
        self.costly = costly or ranked is None

    def retrieved(self, df: DataFrame) -> DataFrame:
        """``df`` with ``documents`` and the ranked names as ``retrieved``."""
        ranked = self.ranked
        if ranked is None:
            if self.vectors is not None:
                known = one_vector(self.vectors, "input_data", "vector")
                ranked = retrieve(df.join(known, "input_data"), self.vocab, self.k)
            else:
                ranked = retrieve(df, self.vocab, self.k)
        lists = document_lists(ranked, self.k).withColumnRenamed("query_id", "row_id")
        return df.join(lists, "row_id", "left").withColumn(
            "retrieved", F.transform("documents", lambda d: d["content"])
        )

    def transform(self, df: DataFrame) -> DataFrame:
        df = self.retrieved(df)
        if self.prompt is not None:
            df = df.withColumn("prompt", self.prompt(df))
        if self.predictor is None:
            return df.withColumn("prediction", F.get("retrieved", F.lit(0)))
        return self.predictor(df)
