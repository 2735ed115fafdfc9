"""The registered queries: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from termeval.durable import materialise
from termeval.functions import prompts, similarity, text
from termeval.operators import list_scores, lookup, search, vector_index, vectors, vocabulary
from termeval.operators.text_index import ConceptIndex
from termeval.operators.vector_grid import nearest_by_blocks
from termeval.plans import evaluation, metrics, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[fx.Tables], DataFrame]):
    """Register ``build`` under its own name."""
    QUERIES[build.__name__] = lambda spark, folder: build(fx.Tables(spark, folder))
    return build


def scored(df: DataFrame, metric: metrics.Metric, places: int | None = None) -> DataFrame:
    value = F.col(metric.label)
    value = value if places is None else F.round(value, places)
    return metric.apply(df).select("row_id", value.alias("score"))


# Column metrics


@query
def exact_match(t):
    return scored(fx.eval_pairs(t), metrics.ExactMatch())


@query
def exact_match_numbers(t):
    """Tax against discount of each line, either no number where there is no tax."""
    taxed = lambda c: F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col(c).cast("double"))
    lines = t.lineitem.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_id"),
        taxed("l_tax").alias("prediction"),
        taxed("l_discount").alias("expected_output"),
    )
    return scored(lines, metrics.ExactMatch())


@query
def uncased_match(t):
    return scored(fx.eval_pairs(t), metrics.UncasedMatch())


@query
def fuzzy_match_ratio(t):
    return scored(fx.eval_pairs(t), metrics.FuzzyMatchRatio(), 6)


@query
def fuzzy_match_turns(t):
    turns = fx.eval_turns(t)
    ratio = similarity.fuzzy_ratio(F.col("prediction"), F.col("input_data"))
    return turns.select("conv_id", "turn", F.round(ratio, 6).alias("score"))


@query
def fuzzy_match_long(t):
    """Descriptions of over 64 letters: each supplier's against the next one's."""
    pairs = fx.eval_descriptions(t)
    return scored(pairs, metrics.FuzzyMatchRatio(), 6)


def shared_words():
    """Scores pairs by the share of their different words that both have."""

    def score(predicted, actual):
        split = [(set(p.lower().split()), set(a.lower().split())) for p, a in zip(predicted, actual)]
        return [len(p & a) / len(p | a) if p | a else None for p, a in split]

    return score


@query
def python_metric(t):
    """A metric of one's own, in Python."""
    pairs = fx.eval_pairs(t).withColumn("prediction", F.when(F.col("row_id") % 7 != 0, F.col("prediction")))
    return scored(pairs, metrics.PythonMetric(shared_words, label="SharedWords"), 6)


def _vector_pairs(t):
    named = fx.concept(t).join(fx.concept_embedding(t), "concept_id")
    means = fx.name_vectors(t).withColumnRenamed("vector", "expected_vector")
    return named.join(means, F.lower("concept_name") == F.col("text")).select(
        F.col("concept_id").alias("row_id"), F.col("embedding").alias("prediction"), "expected_vector"
    )


@query
def dot_similarity(t):
    return scored(_vector_pairs(t), metrics.DotVectorSimilarity(), 4)


@query
def cosine_similarity(t):
    return scored(_vector_pairs(t), metrics.CosineVectorSimilarity(), 4)


# Vocabulary lookups


@query
def ids_matching_name(t):
    return vocabulary.ids_matching_name(fx.name_seeds(t), fx.vocabulary(t))


@query
def ids_matching_name_in_vocabularies(t):
    return vocabulary.ids_matching_name(fx.name_seeds(t), fx.vocabulary(t), fx.BRANDS)


@query
def ancestors_by_name(t):
    return vocabulary.ancestors_by_name(fx.name_seeds(t), fx.vocabulary(t))


@query
def ancestors_by_name_bounded(t):
    return vocabulary.ancestors_by_name(fx.name_seeds(t), fx.vocabulary(t), minimum=1, maximum=2)


@query
def descendants_by_name(t):
    return vocabulary.descendants_by_name(fx.name_seeds(t), fx.vocabulary(t))


@query
def descendants_by_name_bounded(t):
    return vocabulary.descendants_by_name(fx.name_seeds(t), fx.vocabulary(t), minimum=0, maximum=1)


@query
def related_by_name(t):
    return vocabulary.related_by_name(fx.name_seeds(t), fx.vocabulary(t))


@query
def related_by_name_in_vocabularies(t):
    return vocabulary.related_by_name(fx.name_seeds(t), fx.vocabulary(t), fx.BRANDS)


@query
def ancestors_by_id(t):
    return vocabulary.ancestors_by_id(fx.id_seeds(t), fx.vocabulary(t))


@query
def related_by_id(t):
    return vocabulary.related_by_id(fx.id_seeds(t), fx.vocabulary(t))


@query
def all_vocabularies(t):
    return vocabulary.all_vocabularies(fx.vocabulary(t))


# Vector search


@query
def vector_topk(t):
    """The concepts nearest to the mean of all vectors."""
    everything = t.embeddings.withColumn("all", F.lit(0))
    mean = fx.mean_vectors(everything, "all").first()["vector"]
    found = vectors.nearest_concepts(mean, fx.vocabulary(t), 5)
    return found.select("concept_id", "content", F.round("score", 4).alias("score"))


@query
def vector_topk_batch(t):
    """The concepts nearest to the mean vector of each label."""
    found = vectors.nearest_concepts_batch(fx.label_vectors(t), fx.vocabulary(t), 10)
    return found.withColumn("score", F.round("score", 4))


def _own_vectors(t):
    """The vector of each concept that has one: ``(query_id, vector)``."""
    known = fx.concept_embedding(t).join(fx.concept(t), "concept_id", "left_semi")
    return known.select(F.col("concept_id").alias("query_id"), F.col("embedding").alias("vector"))


def _others(found):
    """The five nearest but for the concept itself."""
    order = Window.partitionBy("query_id").orderBy("rank")
    found = found.filter("query_id != concept_id").withColumn("rank", F.row_number().over(order))
    return found.filter("rank <= 5").withColumn("score", F.round("score", 4))


@query
def vector_self_topk(t):
    """The five other concepts nearest to each concept that has a vector."""
    return _others(vectors.nearest_concepts_batch(_own_vectors(t), fx.vocabulary(t), 6))


@query
def vector_grid_topk(t):
    """The same by blocks of queries and of vectors."""
    own = _own_vectors(t)
    known = own.select(F.col("query_id").alias("concept_id"), F.col("vector").alias("embedding"))
    return _others(nearest_by_blocks(own, known, 6, block_rows=512))


def _indexed(t):
    own = _own_vectors(t)
    known = own.select(F.col("query_id").alias("concept_id"), F.col("vector").alias("embedding"))
    return own, vector_index.build(known)


@query
def vector_index_topk(t):
    """The same by an index, whose queries probe some of its cells."""
    own, index = _indexed(t)
    return _others(index.search(own, 6))


@query
def vector_index_every_cell(t):
    """The same by an index, whose queries probe all of its cells."""
    own, index = _indexed(t)
    return _others(index.search(own, 6, probes=len(index.centroids)))


# Text search


@query
def search_term_preprocess(t):
    return t.documents.select(
        "doc_id", text.preprocess_search_term(F.col("text")).alias("search_term")
    )


@query
def text_search(t):
    return search.text_search(fx.name_searches(t), fx.vocabulary(t))


@query
def text_search_all_terms(t):
    return search.text_search(fx.name_searches(t), fx.vocabulary(t), fx.BRANDS, mode="all")


@query
def text_search_synonyms(t):
    return search.text_search(fx.name_searches(t), fx.vocabulary(t), concept_synonym=True)


@query
def text_search_synonyms_all_terms(t):
    return search.text_search(
        fx.name_searches(t), fx.vocabulary(t), fx.BRANDS, concept_synonym=True, mode="all"
    )


@query
def text_search_clauses(t):
    """Names that have one word of each of two lists."""
    return search.text_search(fx.clause_searches(t), fx.vocabulary(t), mode="clauses")


@query
def text_search_indexed(t):
    return ConceptIndex.build(fx.vocabulary(t)).text_search(fx.name_searches(t))


@query
def text_search_indexed_clauses(t):
    """Names or synonyms that have one word of each of two lists, by an index."""
    index = ConceptIndex.build(fx.vocabulary(t))
    return index.text_search(fx.clause_searches(t), fx.BRANDS, concept_synonym=True, mode="clauses")


# Metrics backed by the vocabulary


@query
def related_name_match(t):
    return scored(fx.eval_related(t), metrics.RelatedNameUncasedMatch(fx.vocabulary(t)))


@query
def related_name_match_in_vocabularies(t):
    metric = metrics.RelatedNameUncasedMatch(fx.vocabulary(t), fx.BRANDS)
    return scored(fx.eval_related(t), metric)


def _ancestor_match(t, normalized):
    return metrics.AncestorNameUncasedMatch(
        fx.vocabulary(t),
        min_separation_bound=1,
        max_separation_bound=2,
        normalized=normalized,
    )


@query
def ancestor_name_match(t):
    return scored(fx.eval_hierarchy(t), _ancestor_match(t, True))


@query
def ancestor_name_match_raw(t):
    return scored(fx.eval_hierarchy(t), _ancestor_match(t, False))


@query
def related_name_precision(t):
    metric = metrics.RelatedNamePrecision(fx.vocabulary(t), fx.BRANDS)
    scores = metric.scores(fx.supplier_items(t), fx.order_rows(t))
    return scores.select("row_id", F.round("value", 6).alias("score"))


@query
def ancestor_name_precision(t):
    metric = metrics.AncestorNamePrecision(fx.vocabulary(t), min_separation_bound=1)
    return scored(fx.eval_places(t), metric, 6)


# Precision, recall and F-score


def _order_scores(t, column, beta=1.0):
    scores = list_scores.list_scores(
        fx.predicted_items(t),
        fx.relevant_items(t),
        fx.order_rows(t),
        beta,
        relevant_is_set=True,
    )
    return scores.select("row_id", F.round(column, 6).alias("score"))


@query
def precision(t):
    return _order_scores(t, "precision")


@query
def recall(t):
    return _order_scores(t, "recall")


@query
def fscore(t):
    return _order_scores(t, "f_score", beta=2.0)


# Prompts

INSTRUCTION = "Give the formal name of the item. Answer with the name only."


@query
def prompt_llm(t):
    name = F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name"))
    rendered = prompts.naming_prompt(name, INSTRUCTION, "llama-3.1-8b")
    return t.part.select(F.col("p_partkey").alias("row_id"), rendered.alias("prompt"))


@query
def eot_prompt(t):
    model = F.when(F.col("p_type") == "ECONOMY", "llama-3.1-8b").otherwise("llama-3-8b")
    rendered = prompts.naming_prompt(F.col("p_name"), INSTRUCTION, model)
    return t.part.select(F.col("p_partkey").alias("row_id"), rendered.alias("prompt"))


def plain_prompt(_df):
    lines = prompts.document_lines(F.col("documents"))
    return prompts.naming_prompt(F.col("input_data"), INSTRUCTION, "llama-3.1-8b", lines)


def scored_prompt(_df):
    lines = prompts.scored_document_lines(F.col("documents"))
    return prompts.naming_prompt(F.col("input_data"), INSTRUCTION, "llama-3.1-8b", lines)


def _retrieval_prompt(t, builder):
    pipeline = pipelines.RetrievalPipeline(fx.vocabulary(t), k=5, prompt=builder)
    return pipeline.transform(fx.naming_set(t)).select("row_id", "prompt")


@query
def prompt_rag(t):
    return _retrieval_prompt(t, plain_prompt)


@query
def prompt_rag_scores(t):
    return _retrieval_prompt(t, scored_prompt)


# Evaluations


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("value", F.round("value", 4))


def _pair_metrics():
    return [metrics.ExactMatch(), metrics.UncasedMatch(), metrics.FuzzyMatchRatio()]


def _dataset(t):
    return fx.eval_pairs(t).select("row_id", "input_data", "expected_output")


def _replay(t):
    return pipelines.PromptPipeline(pipelines.replay(fx.recorded_replies(t), ["input_data"]))


@query
def identity_eval(t):
    run = evaluation.Evaluation("identity", pipelines.IdentityPipeline(), _pair_metrics())
    return rounded(run.run(_dataset(t)))


@query
def replay_eval(t):
    run = evaluation.Evaluation("replay", _replay(t), _pair_metrics())
    return rounded(run.run(_dataset(t)))


@query
def embedding_eval(t):
    """Vectors of the inputs against vectors of the expected names."""
    known = fx.name_vectors(t)
    expected = known.select(F.col("text").alias("expected_output"), F.col("vector").alias("expected_vector"))
    run = evaluation.Evaluation(
        "embedding",
        pipelines.EmbeddingPipeline(known),
        [metrics.DotVectorSimilarity(), metrics.CosineVectorSimilarity()],
    )
    return rounded(run.run(_dataset(t).join(expected, "expected_output", "left")))


LETTERS = "abcdefgh"


def letter_counts():
    """An encoder: how often each of eight letters occurs."""
    return lambda texts: [[float(x.count(letter)) for letter in LETTERS] for x in texts]


@query
def encoder_eval(t):
    """Vectors that an encoder gives to the inputs and to the expected names."""
    run = evaluation.Evaluation(
        "encoder",
        pipelines.EncoderPipeline(letter_counts, len(LETTERS), expected=True),
        [metrics.DotVectorSimilarity(), metrics.CosineVectorSimilarity()],
    )
    return rounded(run.run(_dataset(t)))


def retrieval_experiment(t, depths=(5, 10, 20)):
    """Nearest name and retrieved lists at several depths of one ranking."""
    vocab = fx.vocabulary(t)
    dataset = materialise(fx.naming_set(t), "naming-set")
    ranked = materialise(pipelines.retrieve(dataset, vocab, max(depths)), "ranking")
    scores = [
        metrics.UncasedMatch(),
        metrics.FuzzyMatchRatio(),
        metrics.PrecisionMetric(),
        metrics.RecallMetric(),
        metrics.FScoreMetric(2.0),
    ]
    runs = [
        evaluation.Evaluation(
            f"top {k}", pipelines.RetrievalPipeline(vocab, k=k, ranked=ranked), scores
        )
        for k in depths
    ]
    return evaluation.Experiment("retrieval depth", runs), dataset.drop("vector")


@query
def rag_eval(t):
    experiment, dataset = retrieval_experiment(t)
    return rounded(experiment.run(dataset))


def _experiment(t):
    runs = [
        evaluation.Evaluation("identity", pipelines.IdentityPipeline(), _pair_metrics()),
        evaluation.Evaluation("replay", _replay(t), _pair_metrics()),
    ]
    return evaluation.Experiment("names", runs, "Identity against recorded replies")


@query
def evaluation_long(t):
    return rounded(_experiment(t).run(_dataset(t)))


@query
def evaluation_summary(t):
    experiment = _experiment(t)
    summary = evaluation.summarise(experiment.run(_dataset(t)))
    described = experiment.metadata(t.spark).select("pipeline", "metric", "metric_description")
    return summary.join(described, ["pipeline", "metric"]).withColumn(
        "mean_value", F.round("mean_value", 4)
    )


@query
def evaluation_compare(t):
    labels = ["ExactMatch", "UncasedMatch", "FuzzyMatchRatio"]
    means = evaluation.compare(_experiment(t).run(_dataset(t)), labels)
    return means.select("pipeline", *(F.round(label, 4).alias(label) for label in labels))


@query
def retrieval_naming(t):
    """How good is nearest-neighbour retrieval at naming a concept?"""
    run = evaluation.Evaluation(
        "nearest name",
        pipelines.RetrievalPipeline(fx.vocabulary(t), k=5),
        [metrics.UncasedMatch(), metrics.PrecisionMetric()],
    )
    summary = evaluation.summarise(run.run(fx.naming_set(t)))
    return summary.withColumn("mean_value", F.round("mean_value", 6))


# Concept lookup


@query
def concept_lookup(t):
    found = lookup.concept_candidates(fx.name_searches(t), fx.vocabulary(t))
    score = "concept_name_similarity_score"
    return found.withColumn(score, F.round(score, 6))


@query
def concept_lookup_links(t):
    vocab = fx.vocabulary(t)
    found = search.text_search(fx.name_searches(t), vocab, mode="all")
    return lookup.concept_links(found, vocab)


@query
def concept_answers(t):
    """One answer for each search, also for those that match nothing."""
    found = lookup.concept_answers(fx.lookup_searches(t), fx.vocabulary(t), n=5, n_links=4)

    def joined(values, separator=";"):
        return F.array_join(F.transform("CONCEPT", values), separator)

    def names(section):
        return lambda c: F.array_join(F.transform(c[section], lambda x: x["linked_name"]), ",")

    score = lookup.SCORE
    return found.select(
        "query_id",
        "search_term",
        joined(lambda c: c["concept_id"].cast("string")).alias("concept_ids"),
        F.round(F.aggregate("CONCEPT", F.lit(0.0), lambda z, c: z + c[score]), 4).alias("score_sum"),
        *(joined(names(section)).alias(section.lower()) for section in lookup.SECTIONS),
    )
