"""Sources, sinks and the scratch folder."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from moodtide import session
from moodtide.operators.records import decode_trigger, result_lines
from moodtide.operators.registry import analysed_jobs, job_status
from moodtide.sinks import files as sinks
from moodtide.sources import files as sources


def test_csv_keeps_quotes_commas_spaces_and_breaks(spark, tmp_path):
    texts = ['he said "hi", ok', " padded ", "two\nlines", "back\\slash", "plain"]
    rows = spark.createDataFrame([(0, i, "d", "q", "u", text) for i, text in enumerate(texts)], "sentiment int, id long, date string, query_string string, user string, text string")
    sinks.write_training(rows, str(tmp_path / "t"))
    back = sources.training_csv(spark, str(tmp_path / "t"), multi_line=True).orderBy("id")
    assert [row["text"] for row in back.collect()] == texts


def test_reads_files_of_the_standard_csv_writer(spark, tmp_path):
    import csv

    with open(tmp_path / "tweets.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["tweet", "datetime", "replies_count", "retweets_count", "likes_count"])
        writer.writerow(['a "quoted" word', "2021-02-02 09:17:35 UTC", 10, 0, 0])
        writer.writerow(["no time", "x", 1, 2, 3])
        writer.writerow([None, "2021-02-02 09:17:35", 1, 2, 3])
    rows = sources.typed_tweets(sources.tweets_csv(spark, str(tmp_path / "tweets.csv"))).collect()
    assert [(r["text"], str(r["dt"]), r["replies_count"]) for r in rows] == [
        ('a "quoted" word', "2021-02-02 09:17:35", 10),
        ("no time", "None", 1),
    ]


def test_result_lines(spark):
    frame = spark.sql("SELECT timestamp'2021-02-02 09:17:35' AS dt, 4.0D AS prediction UNION ALL SELECT null, 4.0D")
    assert {row["value"] for row in result_lines(frame).collect()} == {"2021-02-02 09:17:35, 4.0", "None, 4.0"}


def test_result_order_survives_many_files(spark, tmp_path):
    rows = spark.range(5000).select(F.lit("hot").alias("job_id"), F.col("id"), F.timestamp_seconds(F.col("id")).alias("dt"), (F.col("id") % 2 * 4.0).alias("prediction"))
    path = str(tmp_path / "r")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_results(rows.repartition(5), path, by_job=True, order_by=["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = sources.results_csv(spark, path)
    assert back.select("seq.file").distinct().count() > 1
    ordered = [row["dt"] for row in back.orderBy("seq").collect()]
    assert ordered == sorted(ordered) and len(ordered) == 5000


def test_clustered_results(spark, tmp_path):
    path = str(tmp_path / "r")
    job = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("j"), F.col("id") % 500))
    moment = F.when(F.col("id") % 7 > 0, F.timestamp_seconds(F.col("id")))
    rows = spark.range(0, 9000, 1, 6).select(job.alias("job_id"), "id", moment.alias("dt"), (F.col("id") % 2 * 4.0).alias("prediction"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sinks.store_results(rows, path, ["id"])
    finally:
        for key in settings:
            spark.conf.set(key, "true")
    index = spark.read.parquet(f"{path}/index")
    # Few files for many jobs, and several for the hot one.
    assert index.select("file").distinct().count() <= 4 < index.select("job_id").distinct().count()
    assert index.where("job_id = 'hot'").count() >= 2
    assert index.agg(F.sum("rows")).first()[0] == 9000
    back = [row["prediction"] for row in sources.rows_by_job(spark, path).where("job_id = 'hot'").orderBy("place").collect()]
    assert back == [i % 2 * 4.0 for i in range(0, 9000, 3)]
    asked = spark.createDataFrame([("j1",), ("j1",), ("j499",), ("unknown",)], "job_id string")
    some = sources.rows_by_job(spark, path, asked)
    assert {row["job_id"] for row in some.collect()} == {"j1", "j499"}
    files = index.where("job_id IN ('j1', 'j499')").select("file").distinct().count()
    assert len(some.inputFiles()) == files < index.select("file").distinct().count()
    assert sources.rows_by_job(spark, path, asked.where("job_id = 'unknown'")).count() == 0
    sinks.export_results(some, str(tmp_path / "e"))
    lines = sources.results_csv(spark, str(tmp_path / "e")).where("job_id = 'j1'").orderBy("seq").collect()
    expected = [i for i in range(9000) if i % 3 and i % 500 == 1]
    assert [row["prediction"] for row in lines] == [i % 2 * 4.0 for i in expected]
    assert [row["dt"] == "None" for row in lines] == [i % 7 == 0 for i in expected]


def test_many_jobs_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "INDEXED_JOBS", 3)
    path = str(tmp_path / "r")
    rows = spark.range(100).select((F.col("id") % 20).alias("job_id"), "id", F.timestamp_seconds("id").alias("dt"), F.lit(4.0).alias("prediction"))
    sinks.store_results(rows, path, ["id"])
    asked = spark.range(5).withColumnRenamed("id", "job_id")
    assert sources.rows_by_job(spark, path, asked).count() == 25
    assert sources.rows_by_job(spark, path, asked.limit(2)).count() == 10


def test_job_documents(spark, tmp_path):
    for job in ("a", "b"):
        folder = tmp_path / "jobs" / job
        folder.mkdir(parents=True)
        record = {"job_id": job, "query": f"about {job}", "created_at": "2021-02-02 09:00:00.123456"}
        (folder / "meta.json").write_text(json.dumps(record, indent=1 if job == "b" else None))
        (folder / "results.csv").write_text("2021-02-02 09:17:35, 4.0\n")
    assert sources.job_documents(spark, str(tmp_path), multi_line=True).select("job_id").distinct().count() == 2
    listing = sources.relative_paths(sources.object_listing(spark, str(tmp_path)))
    assert {row["path"] for row in listing.select("path").collect()} == {
        f"jobs/{job}/{name}" for job in ("a", "b") for name in ("meta.json", "results.csv")
    }


def test_failure_leaves_a_marker_and_is_raised(spark, tmp_path):
    path = str(tmp_path / "errors")

    def fail():
        raise ValueError("no such cluster")

    with pytest.raises(ValueError):
        sinks.recording_failure(spark, "j1", path, fail)
    assert [tuple(row) for row in spark.read.json(path).collect()] == [("j1", "no such cluster")]
    assert sinks.recording_failure(spark, "j2", path, lambda: 7) == 7


def test_status_of_listed_files_and_failures(spark, tmp_path):
    encoded = "base64:" + base64.b64encode(b"a b").decode()
    for job in ("done", "failed", "begun", encoded):
        folder = tmp_path / "jobs" / job
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text("{}")
        if job != "begun":
            (folder / "results.csv").write_text("2021-02-02 09:17:35, 4.0\n")
    (tmp_path / "jobs" / "failed" / "_error").touch()
    errors = str(tmp_path / "errors")
    for job in ("failed", "failed", "gone"):
        with pytest.raises(ZeroDivisionError):
            sinks.recording_failure(spark, job, errors, lambda: 1 / 0)
    listing = sources.relative_paths(sources.object_listing(spark, str(tmp_path / "jobs")))
    jobs = spark.createDataFrame([(job,) for job in ("done", "failed", "begun", "a b", "gone", "never")], "job_id string")
    failed = sources.failures(spark, errors)
    assert dict(map(tuple, job_status(jobs, listing, failed).collect())) == {
        "done": "done", "failed": "error", "begun": "in_progress", "a b": "done", "gone": "error", "never": "missing",
    }
    assert {row["job_id"] for row in analysed_jobs(listing, failed).collect()} == {"done", "begun", "a b"}


def test_trigger_payload(values):
    record = {"job_id": "j", "query": "some phrase", "created_at": "2021"}
    payload = base64.b64encode(json.dumps(record).encode()).decode()
    assert [row.asDict() for row in values(decode_trigger, [payload])] == [record]


def test_a_hot_job_is_staged_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "staged")
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        job = F.when(F.col("id") % 3 == 0, F.concat(F.lit("j"), F.col("id") % 20)).otherwise(F.lit("hot"))
        sinks.stage_by_job(spark.range(0, 60_000, 1, 8).select(job.alias("job_id"), "id"), path)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert spark.read.parquet(path).count() == 60_000
    assert sources.object_listing(spark, f"{path}/job_id=hot", "*.parquet").count() > 1


class _Conf:
    def get(self, key, default=None):
        return None


class _Context:
    applicationId = "app-without-a-folder"

    def __init__(self, master):
        self.master = master

    def getConf(self):
        return _Conf()


class _Session:
    conf = _Conf()

    def __init__(self, master):
        self.sparkContext = _Context(master)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_root(_Session("yarn"))


def test_scratch_falls_back_only_in_a_local_session():
    first = session.shared_root(_Session("local[2]"))
    assert first == session.shared_root(_Session("local[2]"))


def test_scratch_paths_lie_in_the_configured_folder(spark):
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second and first.startswith(session.shared_root(spark) + "/x-")


def test_small_folders_are_written_by_many_tasks(spark, tmp_path):
    """AQE would merge so few bytes into one task, which then makes all files one after the other."""
    rows = spark.range(120).select((F.col("id") % 40).alias("folder"), F.col("id"))
    for _ in range(2):
        sinks.write_folders(rows, str(tmp_path / "out"), "parquet")
    names = [file.name for file in (tmp_path / "out").glob("folder=*/part-*.parquet")]
    assert len(names) == 80 and len({name.split("-")[1] for name in names}) > 4
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 240 and back.distinct().exceptAll(rows.select("id", F.col("folder").cast("int").alias("folder"))).count() == 0
