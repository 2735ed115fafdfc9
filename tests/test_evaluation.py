import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from termeval.durable import materialise, shared_folder
from termeval.functions import prompts
from termeval.plans import evaluation as ev
from termeval.plans import metrics as m
from termeval.plans import pipelines as p
from termeval.sources import results


@pytest.fixture
def dataset(spark):
    data = [(0, "aspirin", "aspirin"), (1, "Tylenol", "acetaminophen"), (2, "codeine ", "Codeine")]
    return spark.createDataFrame(data, "row_id bigint, input_data string, expected_output string")


def identity(*metrics):
    return ev.Evaluation("identity", p.IdentityPipeline(), metrics or [m.ExactMatch(), m.UncasedMatch()])


def test_long_form(dataset, rows):
    assert rows(identity().run(dataset)) == [
        ("identity", 0, "ExactMatch", 1.0),
        ("identity", 0, "UncasedMatch", 1.0),
        ("identity", 1, "ExactMatch", 0.0),
        ("identity", 1, "UncasedMatch", 0.0),
        ("identity", 2, "ExactMatch", 0.0),
        ("identity", 2, "UncasedMatch", 1.0),
    ]


def test_labels_and_names_must_differ():
    with pytest.raises(ValueError, match="labels"):
        identity(m.ExactMatch(), m.ExactMatch())
    identity(m.FScoreMetric(1.0), m.FScoreMetric(2.0, label="F2"))
    with pytest.raises(ValueError, match="names"):
        ev.Experiment("e", [identity(), identity()])


def test_summary_and_comparison(spark, dataset, rows):
    upper = ev.Evaluation("null", p.ColumnPipeline(F.lit(None).cast("string")), [m.UncasedMatch()])
    scores = ev.Experiment("e", [identity(), upper]).run(dataset)
    assert rows(ev.summarise(scores)) == [
        ("identity", "ExactMatch", 1 / 3, 3, 0),
        ("identity", "UncasedMatch", 2 / 3, 3, 0),
        ("null", "UncasedMatch", None, 3, 3),
    ]
    wide = ev.compare(scores, ["UncasedMatch", "ExactMatch"])
    assert rows(wide) == [("identity", 2 / 3, 1 / 3), ("null", None, None)]


def test_replayed_replies(spark, dataset, rows):
    replies = spark.createDataFrame(
        [("aspirin", " Aspirin"), ("aspirin", " Aspirin"), ("Tylenol", "x")], "input_data string, reply string"
    )
    pipeline = p.PromptPipeline(p.replay(replies, ["input_data"]))
    assert rows(pipeline.transform(dataset), "row_id", "prediction") == [(0, " Aspirin"), (1, "x"), (2, None)]
    clash = replies.union(spark.createDataFrame([("Tylenol", "y")], replies.schema))
    with pytest.raises(PySparkException, match="two different replies"):
        p.PromptPipeline(p.replay(clash, ["input_data"])).transform(dataset).collect()


def test_model_predictor_answers_prompts_once(spark, dataset, rows, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def model(batch):
            with open(calls, "a") as log:
                log.write("x" * len(batch))
            return [text.rsplit(": ", 1)[1].removesuffix("\nResponse:") for text in batch]

        return model

    pipeline = p.PromptPipeline(
        p.model_predictor(load),
        lambda df: prompts.naming_prompt(F.col("input_data"), "Name it.", "llama-3-8b"),
        costly=True,
    )
    run = ev.Evaluation("model", pipeline, [m.ExactMatch(), m.FuzzyMatchRatio()]).run(dataset)
    assert rows(run.filter("metric = 'ExactMatch'"), "row_id", "value") == [(0, 1.0), (1, 0.0), (2, 0.0)]
    assert run.count() == 6
    assert len(open(calls).read()) == 3


def test_embedding_pipeline(spark, dataset, rows):
    vectors = spark.createDataFrame([("aspirin", [1.0, 2.0])], "text string, vector array<double>")
    found = p.EmbeddingPipeline(vectors).transform(dataset)
    assert rows(found, "row_id", "prediction") == [(0, [1.0, 2.0]), (1, None), (2, None)]


def test_retrieval_pipeline(spark, vocab, rows):
    data = [(0, "paracetamol", "Acetaminophen"), (1, "codein", "Codeine"), (2, "none", "Codeine")]
    dataset = spark.createDataFrame(data, "row_id bigint, input_data string, expected_output string")
    vectors = spark.createDataFrame(
        [("paracetamol", [1.0, 0.1, 0.0]), ("codein", [0.0, 1.0, 0.0])], "text string, vector array<double>"
    )
    seen = []

    def prompt(df):
        seen.append(df.columns)
        lines = prompts.scored_document_lines(F.col("documents"), 2)
        return prompts.naming_prompt(F.col("input_data"), "Name it.", "llama-3.1-8b", lines)

    pipeline = p.RetrievalPipeline(vocab, k=2, vectors=vectors, prompt=prompt)
    found = pipeline.transform(dataset)
    assert rows(found, "row_id", "prediction", "retrieved") == [
        (0, "Acetaminophen Oral Tablet", ["Acetaminophen Oral Tablet", "Acetaminophen"]),
        (1, "Codeine", ["Codeine", "Acetaminophen Oral Tablet"]),
        (2, None, None),
    ]
    text = found.filter("row_id = 1").first().prompt
    assert "    Codeine (cosine distance = 0.00)\n    Acetaminophen Oral Tablet (cosine distance = 0.89)\n" in text
    assert "codein<|eot_id|>" in text and "documents" in seen[0]


def test_rankings_are_shared_by_prefix(spark, vocab, rows):
    dataset = spark.createDataFrame(
        [(0, "a", "Codeine", [0.0, 1.0, 0.0])],
        "row_id bigint, input_data string, expected_output string, vector array<double>",
    )
    ranked = p.retrieve(dataset, vocab, 4)
    for k in (1, 2, 4):
        shared = p.RetrievalPipeline(vocab, k=k, ranked=ranked).transform(dataset)
        alone = p.RetrievalPipeline(vocab, k=k).transform(dataset)
        assert rows(shared, "retrieved", "prediction") == rows(alone, "retrieved", "prediction")


def test_materialised_rows_stay_as_they_were(spark):
    df = spark.range(100).withColumn("r", F.rand())
    kept = materialise(df, "test")
    assert kept.collect() == kept.collect() and kept.dtypes == df.dtypes
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)


def document(path):
    parts = sorted(f for f in path.iterdir() if f.name.startswith("part-"))
    return json.loads("".join(f.read_text() for f in parts))


def test_result_log_and_document(spark, dataset, rows, tmp_path):
    log = results.ResultLog(spark, str(tmp_path / "log"))
    quoted = 'An "experiment", é'
    first = ev.Experiment("007", [identity(m.FuzzyMatchRatio(), m.ExactMatch())], quoted, time=1.5)
    nothing = ev.Evaluation("no answer", p.ColumnPipeline(F.lit(None).cast("string")), [m.UncasedMatch()])
    second = ev.Experiment("second", [nothing, identity()], time=2.5)
    for experiment in (first, second):
        log.append(experiment, experiment.run(dataset))
    assert log.scores().count() == 6 + 9
    assert {r.experiment for r in log.scores().select("experiment").distinct().collect()} == {"007", "second"}

    log.write_nested_document(str(tmp_path / "document"))
    found = document(tmp_path / "document")
    assert [(e["Experiment"], e["Description"], e["Time"]) for e in found] == [("007", quoted, 1.5), ("second", "", 2.5)]
    (only,) = found[0]["Results"]
    assert only["identity"]["metric_descriptions"] == [m.FuzzyMatchRatio.description, m.ExactMatch.description]
    assert [list(r) for r in only["identity"]["results"]] == [["FuzzyMatchRatio", "ExactMatch"]] * 3
    assert [r["ExactMatch"] for r in only["identity"]["results"]] == [1.0, 0.0, 0.0]
    assert [list(r) for r in found[1]["Results"]] == [["no answer"], ["identity"]]
    assert found[1]["Results"][0]["no answer"]["results"] == [{"UncasedMatch": None}] * 3

    stored = tmp_path / "results.json"
    stored.write_text(json.dumps(found))
    back = results.read_nested_document(spark, str(stored))
    assert rows(back.filter("pipeline = 'identity' AND experiment = '007'"), "row_id", "metric", "value") == rows(
        log.scores().filter("pipeline = 'identity' AND experiment = '007'"), "row_id", "metric", "value"
    )


def test_written_documents_are_read_whole(spark, rows, tmp_path):
    many = spark.range(2000).select(
        F.col("id").alias("row_id"), F.col("id").cast("string").alias("input_data"), F.lit("7").alias("expected_output")
    ).repartition(4)
    log = results.ResultLog(spark, str(tmp_path / "log"))
    first, second = ev.Experiment("one", [identity()], "first", time=1.5), ev.Experiment("two", [identity()], time=2.5)
    log.append(first, first.run(many))
    log.write_document(str(tmp_path / "document"))
    assert len([f for f in (tmp_path / "document").iterdir() if f.name.startswith("part-")]) >= 2
    columns = ["run_id", "experiment", "pipeline", "row_id", "metric", "value"]
    back = results.read_document(spark, str(tmp_path / "document"))
    assert rows(back, *columns) == rows(log.scores(), *columns) and back.count() >= 2000
    assert {(r.description, r.time) for r in back.select("description", "time").distinct().collect()} == {("first", 1.5)}
    log.append(second, second.run(many))
    log.write_document(str(tmp_path / "again"))
    assert rows(results.read_document(spark, str(tmp_path / "again")), *columns) == rows(log.scores(), *columns)


def test_unfinished_runs_are_not_read(spark, dataset, tmp_path):
    log = results.ResultLog(spark, str(tmp_path / "log"))
    done, failed = ev.Experiment("done", [identity()]), ev.Experiment("failed", [identity()])
    log.append(done, done.run(dataset))
    failed.metadata = lambda spark: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        log.append(failed, failed.run(dataset))
    assert {r.experiment for r in log.scores().collect()} == {"done"}


def test_appending_a_run_again_changes_nothing(spark, dataset, rows, tmp_path):
    log = results.ResultLog(spark, str(tmp_path / "log"))
    one, other = ev.Experiment("one", [identity()]), ev.Experiment("other", [identity()], run_id="0012")
    for experiment in (one, other, one):
        log.append(experiment, experiment.run(dataset))
    assert log.scores().count() == 2 * one.run(dataset).count() and log.runs().count() == 2 * one.metadata(spark).count()
    assert {r.run_id for r in log.scores().collect()} == {one.run_id, "0012"}


def test_an_append_that_broke_off_is_done_again(spark, dataset, tmp_path):
    log = results.ResultLog(spark, str(tmp_path / "log"))
    run = ev.Experiment("run", [identity()])
    metadata = run.metadata
    run.metadata = lambda spark: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        log.append(run, run.run(dataset))
    run.metadata = metadata
    log.append(run, run.run(dataset))
    assert log.scores().count() == run.run(dataset).count()


def test_a_recorded_run_leaves_only_its_scores(spark, dataset, tmp_path):
    seen = []

    class Once(p.IdentityPipeline):
        costly = True

        def transform(self, df):
            seen.append(df)
            return super().transform(df)

    experiment = ev.Experiment("two", [ev.Evaluation(x, Once(), [m.ExactMatch()]) for x in "ab"])
    before = set(os.listdir(f"{shared_folder(spark)}/termeval"))
    log = results.ResultLog(spark, str(tmp_path / "log"))
    log.record(experiment, dataset)
    assert set(os.listdir(f"{shared_folder(spark)}/termeval")) == before
    assert log.scores().count() == 6 and len(seen) == 2


# Encoders and metrics of one's own


def letters():
    return lambda texts: [[float(len(x)), float(x.count("a"))] for x in texts]


def test_encoder_pipeline(spark, rows):
    data = [(0, "banana", "a"), (1, None, "b"), (2, "", None), (3, "banana", "a")]
    df = spark.createDataFrame(data, "row_id bigint, input_data string, expected_output string")
    found = p.EncoderPipeline(letters, 2, expected=True).transform(df)
    assert dict(found.dtypes)["prediction"] == "array<float>"
    assert rows(found, "row_id", "prediction", "expected_vector") == [
        (0, [6.0, 3.0], [1.0, 1.0]), (1, None, [1.0, 0.0]), (2, [0.0, 0.0], None), (3, [6.0, 3.0], [1.0, 1.0]),
    ]
    run = ev.Evaluation("encoder", p.EncoderPipeline(letters, 2, expected=True), [m.DotVectorSimilarity()])
    assert rows(run.run(df), "row_id", "value") == [(0, 9.0), (1, None), (2, None), (3, 9.0)]


def test_vectors_of_another_width_fail(spark, dataset):
    with pytest.raises(PySparkException, match="of width 3"):
        p.EncoderPipeline(letters, 3).transform(dataset).collect()


def test_two_vectors_of_one_text_fail(spark, dataset):
    data = [("aspirin", [1.0, 2.0]), ("aspirin", [1.0, 2.0]), ("other", [0.0, 0.0]), ("other", [0.0, 1.0])]
    vectors = spark.createDataFrame(data, "text string, vector array<double>")
    same = p.EmbeddingPipeline(vectors.where("text = 'aspirin'")).transform(dataset)
    assert same.count() == 3
    with pytest.raises(PySparkException, match="two different vectors"):
        p.EmbeddingPipeline(vectors).transform(dataset).collect()


def lengths():
    return lambda predicted, actual: [None if p == "" else len(p or "") + len(a or "") for p, a in zip(predicted, actual)]


def test_python_metric(spark, rows):
    data = [(0, "ab", "c"), (1, None, "c"), (2, "ab", None), (3, "", "c")]
    df = spark.createDataFrame(data, "row_id bigint, prediction string, expected_output string")
    strict, loose = m.PythonMetric(lengths, label="x"), m.PythonMetric(lengths, label="x", nulls=True)
    assert rows(strict.apply(df), "row_id", "x") == [(0, 3.0), (1, None), (2, None), (3, None)]
    assert rows(loose.apply(df), "row_id", "x") == [(0, 3.0), (1, 1.0), (2, 2.0), (3, None)]
    with pytest.raises(PySparkException, match="0 scores for"):
        m.PythonMetric(lambda: lambda p, a: [], label="x").apply(df).collect()
