"""Metrics: a column expression, or one join for the whole evaluation set."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.functions import lists, similarity
from termeval.functions.text import normalise
from termeval.operators.list_scores import named_list_precision
from termeval.operators.vocabulary import ancestor_edges, name_pairs, related_edges
from termeval.sources.vocabulary import Vocabulary


class Metric(ABC):
    """A score per row of an evaluation set with predictions.

    ``predicted`` and ``actual`` name the compared columns.
    """

    description = ""
    predicted = "prediction"
    actual = "expected_output"

    def __init__(
        self,
        label: str | None = None,
        predicted: str | None = None,
        actual: str | None = None,
    ):
        self.label = label or type(self).__name__
        self.predicted = predicted or self.predicted
        self.actual = actual or self.actual

    @abstractmethod
    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the score in a column named by the label."""


class ColumnMetric(Metric):
    """A metric computed from the two columns alone."""

    @abstractmethod
    def expr(self, predicted: Column, actual: Column) -> Column: ...

    def apply(self, df: DataFrame) -> DataFrame:
        score = self.expr(F.col(self.predicted), F.col(self.actual))
        return df.withColumn(self.label, score)


class ExactMatch(ColumnMetric):
    description = "Exact match: prediction and expected output are the same"

    def expr(self, predicted, actual):
        return similarity.exact_match(predicted, actual)

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = {df.schema[c].dataType.simpleString() for c in (self.predicted, self.actual)}
        if kinds & {"float", "double"}:
            # A number that is no number equals nothing, itself included.
            score = similarity.exact_match_float(F.col(self.predicted), F.col(self.actual))
            return df.withColumn(self.label, score)
        return super().apply(df)


class UncasedMatch(ColumnMetric):
    description = "Uncased match: equal when case and surrounding whitespace are ignored"

    def expr(self, predicted, actual):
        return (normalise(predicted) == normalise(actual)).cast("double")


class FuzzyMatchRatio(ColumnMetric):
    description = "Fuzzy match: normalized indel similarity, 0 to 100, ignoring case"

    def expr(self, predicted, actual):
        return similarity.fuzzy_ratio(predicted, actual)


class DotVectorSimilarity(ColumnMetric):
    description = "Dot product of the predicted and the expected vector"
    actual = "expected_vector"

    def expr(self, predicted, actual):
        return similarity.dot(predicted, actual)


class CosineVectorSimilarity(ColumnMetric):
    description = "Cosine similarity of the predicted and the expected vector"
    actual = "expected_vector"

    def expr(self, predicted, actual):
        return similarity.cosine(predicted, actual)


class PythonMetric(ColumnMetric):
    """A metric of one's own in Python, on batches of both columns.

    ``load`` is called once per task in the Python worker and returns a function
    from a batch of predictions and one of expected outputs, of equal length, to
    as many scores. Rows with a NULL on either side score NULL and are not handed
    on, unless ``nulls=True``; a score of None or NaN is NULL. A function that
    returns another number of scores fails the job.
    """

    def __init__(
        self,
        load: Callable[[], Callable[[list, list], Sequence[float | None]]],
        description: str = "",
        nulls: bool = False,
        **names,
    ):
        super().__init__(**names)
        self.load = load
        self.nulls = nulls
        self.description = description

    def expr(self, predicted, actual):
        load, nulls = self.load, self.nulls

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            function = load()
            for p, a in batches:
                asked = pd.Series(True, index=p.index) if nulls else p.notna() & a.notna()
                found = pd.Series(float("nan"), index=p.index, dtype=float)
                given = list(function(p[asked].tolist(), a[asked].tolist())) if asked.any() else []
                if len(given) != int(asked.sum()):
                    raise ValueError(f"{len(given)} scores for {int(asked.sum())} rows")
                found[asked] = pd.Series(given, index=p.index[asked], dtype=float)
                yield found

        found = score(predicted, actual)
        return F.when(~F.isnan(found), found)


class _ListMetric(ColumnMetric):
    """Metrics of a predicted array against an array of relevant items."""

    predicted = "retrieved"
    actual = "relevant"

    def __init__(self, on_undefined: str = "null", **names):
        super().__init__(**names)
        self.on_undefined = on_undefined


class PrecisionMetric(_ListMetric):
    description = "Precision: share of the predicted items that are relevant"

    def expr(self, predicted, actual):
        return lists.precision(predicted, actual, self.on_undefined)


class RecallMetric(_ListMetric):
    description = "Recall: predicted relevant items per relevant item"

    def expr(self, predicted, actual):
        return lists.recall(predicted, actual, self.on_undefined)


class FScoreMetric(_ListMetric):
    def __init__(self, beta: float = 1.0, on_undefined: str = "null", **names):
        super().__init__(on_undefined, **names)
        self.beta = beta
        self.description = f"F-score: precision and recall combined with beta {beta}"

    def expr(self, predicted, actual):
        return lists.f_score(predicted, actual, self.beta, self.on_undefined)


class _VocabularyMetric(Metric):
    """Metrics that ask the vocabulary about the expected concept's neighbours."""

    def __init__(
        self, vocab: Vocabulary, vocabulary_ids: Sequence[str] | None = None, **names
    ):
        super().__init__(**names)
        self.vocab = vocab
        self.vocabulary_ids = vocabulary_ids

    def edges(self) -> DataFrame:
        return related_edges(self.vocab)


class _Ancestors:
    """Neighbours are the ancestors within separation bounds."""

    def __init__(
        self,
        vocab: Vocabulary,
        vocabulary_ids: Sequence[str] | None = None,
        min_separation_bound: int = 0,
        max_separation_bound: int | None = None,
        **names,
    ):
        super().__init__(vocab, vocabulary_ids, **names)
        self.bounds = (min_separation_bound, max_separation_bound)

    def edges(self) -> DataFrame:
        return ancestor_edges(self.vocab, *self.bounds)


class _NameMatch(_VocabularyMetric):
    """1 for the expected name itself or a neighbour's name, else 0."""

    def compared(self, name: Column) -> Column:
        return normalise(name)

    def sought(self, predicted: Column) -> Column:
        return normalise(predicted)

    def apply(self, df: DataFrame) -> DataFrame:
        predicted, actual = F.col(self.predicted), F.col(self.actual)
        keyed = df.withColumns(
            {"seed_key": F.lower(actual), "target_key": self.sought(predicted)}
        )
        # Read twice more, and a model should not predict again for it.
        keyed = materialise(keyed, "name-match")
        pairs = name_pairs(self.edges(), self.vocab, keyed, self.vocabulary_ids)
        found = keyed.join(
            pairs.withColumn("_linked", F.lit(True)), ["seed_key", "target_key"], "left"
        )
        equal = self.compared(predicted) == self.compared(actual)
        score = F.when(
            predicted.isNotNull() & actual.isNotNull(),
            (equal | F.coalesce("_linked", F.lit(False))).cast("double"),
        )
        return found.withColumn(self.label, score).drop("seed_key", "target_key", "_linked")


class RelatedNameUncasedMatch(_NameMatch):
    description = "Related name: the prediction names the expected or a related concept"


class AncestorNameUncasedMatch(_Ancestors, _NameMatch):
    """As related names, over ancestors.

    ``normalized=False`` compares predictions unstripped, and looks them up
    among the lower-cased ancestor names exactly as they are.
    """

    description = "Ancestor name: the prediction names the expected concept or an ancestor"

    def __init__(self, *args, normalized: bool = True, **options):
        super().__init__(*args, **options)
        self.normalized = normalized

    def compared(self, name):
        return normalise(name) if self.normalized else F.lower(name)

    def sought(self, predicted):
        return normalise(predicted) if self.normalized else predicted


class _NamePrecision(_VocabularyMetric):
    """Share of a predicted list found among the neighbours' names, cased."""

    predicted = "retrieved"

    def __init__(self, *args, on_undefined: str = "null", **options):
        super().__init__(*args, **options)
        self.on_undefined = on_undefined

    def scores(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """``(row_id, value)`` of lists given as rows ``(row_id, name, item)``."""
        keyed = items.select(
            "row_id", F.lower("name").alias("seed_key"), F.col("item").alias("target_key")
        )
        keyed = materialise(keyed, "name-lists")
        pairs = name_pairs(
            self.edges(), self.vocab, keyed, self.vocabulary_ids, lower_targets=False
        )
        return named_list_precision(keyed, pairs, rows, self.on_undefined)

    def apply(self, df: DataFrame) -> DataFrame:
        items = df.select(
            "row_id",
            F.col(self.actual).alias("name"),
            F.explode(self.predicted).alias("item"),
        )
        scored = self.scores(items, df.filter(F.col(self.predicted).isNotNull()))
        return df.join(scored.withColumnRenamed("value", self.label), "row_id", "left")


class RelatedNamePrecision(_NamePrecision):
    description = "Related name precision: share of predicted names of related concepts"


class AncestorNamePrecision(_Ancestors, _NamePrecision):
    description = "Ancestor name precision: share of predicted names of ancestors"
