"""Training, stored models, and streams against batches."""

import json

import pytest
from pyspark.sql import functions as F

from moodtide.operators.features import VOCABULARY_SIZE
from moodtide.operators.records import parse_messages
from moodtide.plans.scoring import predict
from moodtide.plans.training import MAX_ITERATIONS, Settings, fit, train_and_store, unigram_stages
from moodtide.sources.files import load_model
from moodtide.sources.streams import message_files, table_files
from moodtide.streaming import flows

SMALL = Settings(vocabulary_size=500, max_iterations=15)


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "love this great happy day @me", "hate this awful sad day http://x.co"
    rows = [(i, 4 if i % 2 else 0, f"{good if i % 2 else bad} number{i % 7}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, sentiment int, text string").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, labelled, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    model, predicted = train_and_store(labelled, "doc_id", root, SMALL)
    return root, model, predicted


def test_defaults():
    assert (Settings().vocabulary_size, Settings().max_iterations) == (VOCABULARY_SIZE, MAX_ITERATIONS) == (80_000, 5000)


def test_learns_and_scores(spark, stored):
    root, _, predicted = stored
    assert predicted.where("sentiment <> prediction").count() == 0
    assert spark.read.parquet(f"{root}/models/v5/held_out").exceptAll(predicted).count() == 0
    assert {row["prediction"] for row in predicted.collect()} == {0.0, 4.0}
    assert spark.read.json(f"{root}/models/v5/scores").first()["accuracy"] == 1.0
    report = spark.read.json(f"{root}/models/v5/report")
    assert {row["class"] for row in report.collect()} == {"0", "4", "macro avg", "weighted avg"}


def test_reloaded_model_predicts_the_same(labelled, stored):
    root, model, _ = stored
    texts = labelled.select("doc_id", "text")
    first = predict(texts, model, ["doc_id"])
    assert first.exceptAll(predict(texts, load_model(root), ["doc_id"])).count() == 0


def test_ties_in_the_vocabulary_are_stable(labelled):
    settings = Settings(vocabulary_size=9, max_iterations=2)
    first = fit(labelled, settings).stages[-3].vocabulary
    second = fit(labelled.repartition(7), settings).stages[-3].vocabulary
    assert sorted(first) == sorted(second) and len(first) == 9


def test_variants(labelled):
    raw = fit(labelled, Settings(text_col="text", vocabulary_size=500, max_iterations=5, partitions=3, drop_empty=True))
    assert "@me" in raw.stages[-3].vocabulary
    single = fit(labelled, SMALL, unigram_stages(SMALL))
    assert not any(" " in term or term == "this" for term in single.stages[-3].vocabulary)


def test_vectors_are_computed_once(spark, labelled):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    fit(labelled.mapInPandas(count, labelled.schema), SMALL, unigram_stages(SMALL))
    # The rows pass once for the counts of the terms and once for the vectors.
    assert seen.value == 2 * 200


def test_texts_of_ngrams_are_cleaned_once(spark, labelled):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    model = fit(labelled.mapInPandas(count, labelled.schema), SMALL)
    assert seen.value == 200
    assert sorted(model.stages[-3].vocabulary) == sorted(fit(labelled, SMALL).stages[-3].vocabulary)


def _messages(labelled):
    tweet = F.struct("text", F.lit("2021-02-02 09:17:35").alias("created_at"))
    job = F.struct(F.lit("j").alias("job_id"), F.lit("day").alias("query"), F.lit("2021-02-02 09:00:00").alias("created_at"))
    return labelled.select(F.to_json(F.struct(tweet.alias("tweet"), job.alias("job_config"))).alias("value"))


def test_stream_equals_batch(spark, labelled, stored, tmp_path):
    root, model, _ = stored
    _messages(labelled).write.text(str(tmp_path / "in"))
    stream = flows.sentiment_stream(message_files(spark, str(tmp_path / "in"), 1), load_model(root))
    flows.finish(flows.append_to_files(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True))
    batch = flows.sentiment_stream(_messages(labelled), model)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200 and batch.exceptAll(out).count() == 0
    # Nothing new arrived: a restarted query adds nothing.
    stream = flows.sentiment_stream(message_files(spark, str(tmp_path / "in"), 1), load_model(root))
    flows.finish(flows.append_to_files(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_append_to_table(spark, labelled, tmp_path):
    _messages(labelled).write.text(str(tmp_path / "in"))
    parsed = parse_messages(message_files(spark, str(tmp_path / "in"))).select("tweet.text")
    # The table does not exist yet.
    try:
        flows.finish(flows.append_to_table(parsed, "sentiment_rows", str(tmp_path / "check"), once=True))
        assert spark.table("sentiment_rows").count() == 200
    finally:
        spark.sql("DROP TABLE sentiment_rows")


def test_service_mode_goes_on_with_new_files(spark, labelled, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _messages(labelled).where("value LIKE '%love%'").write.text(source)
    stream = parse_messages(message_files(spark, source)).select("tweet.text")
    running = flows.append_to_files(stream, out, str(tmp_path / "check"), interval="1 second")
    try:
        running.processAllAvailable()
        assert spark.read.parquet(out).count() == 100
        _messages(labelled).where("value LIKE '%hate%'").write.mode("append").text(source)
        running.processAllAvailable()
        assert spark.read.parquet(out).count() == 200 and running.isActive
    finally:
        running.stop()


def test_unreadable_messages_are_kept_apart(spark):
    good = json.dumps({"tweet": {"text": "x", "created_at": None}, "job_config": {"job_id": "j"}})
    raw = spark.createDataFrame([(good,), ("{broken",), ('{"tweet": {}}',), (None,)], "value string")
    assert parse_messages(raw).count() == 1
    assert flows.clean_messages(raw).count() == 1
    assert flows.unreadable_messages(raw).count() == 3


def test_windows_over_several_batches(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.col("id") * 3 % 100).alias("ts"), F.col("id").cast("double").alias("value"))
    with_null = rows.unionByName(spark.sql("SELECT cast(null AS timestamp) AS ts, 1D AS value"))
    with_null.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = table_files(spark, str(tmp_path / "in"), rows.schema, 2)
    flows.finish(flows.append_window_parts(stream, "ts", "value", str(tmp_path / "out"), str(tmp_path / "check"), once=True))
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert versions.select("batch").distinct().count() > 1
    expected = rows.groupBy(F.window("ts", "10 seconds").start.alias("window_start")).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")
    )
    found = flows.merged_windows(versions)
    assert found.count() == expected.count() == expected.join(found, ["window_start", "n"]).count()


def test_tag_window_keeps_rows_without_a_time(spark):
    rows = spark.sql("SELECT timestamp'2021-02-02 09:17:35.5' AS ts UNION ALL SELECT null")
    tagged = flows.tag_window(rows, "ts").collect()
    assert {str(row["window_start"]) for row in tagged} == {"2021-02-02 09:17:30", "None"}


def test_fan_out_stream_limits_each_batch(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta"
    tweets = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(text).alias("text"), F.lit("2021-02-02 09:17:35 UTC").alias("datetime"))
    tweets.repartition(2).write.parquet(str(tmp_path / "in"))
    jobs = spark.createDataFrame([("j", "GAMMA", "2021")], "job_id string, query string, created_at string")
    stream = table_files(spark, str(tmp_path / "in"), tweets.schema, 1)
    flows.finish(flows.fan_out_stream(stream, jobs, ["doc_id"], str(tmp_path / "out"), str(tmp_path / "check"), limit=5, once=True))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("batch").count().select("count").collect() == [(5,), (5,)]
