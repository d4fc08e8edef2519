"""Very many small folders: written like Spark's partitions, listed in few tasks."""

import pytest
from pyspark.sql import functions as F

from moodtide.sinks import files as sinks
from moodtide.sources import files as sources

NAMES = ["a", "b c", "x=1", "50%", "a/b", "c:d", 'q"', "é", "#'*?\\{[]^", None, "", "tab\t"]


@pytest.fixture
def rows(spark):
    held = [(i, NAMES[i % len(NAMES)], None if i % 5 == 0 else f"text {i}\n, \"quoted\"", i / 3) for i in range(240)]
    return spark.createDataFrame(held, "id long, folder string, text string, part double").withColumn("at", F.timestamp_seconds("id"))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_folders_are_those_of_spark(spark, rows, tmp_path, kind, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        made = sinks.write_folders(rows, str(tmp_path / "own"), kind)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.write.partitionBy("folder").format(kind).save(str(tmp_path / "spark"))
    schema = rows.schema
    own, expected = (spark.read.schema(schema).format(kind).load(str(tmp_path / name)) for name in ("own", "spark"))
    assert own.count() == 240 and own.exceptAll(expected).count() == 0
    folders = {name: {one.name for one in (tmp_path / name).iterdir() if one.is_dir()} for name in ("own", "spark")}
    assert folders["own"] == folders["spark"]
    # One file a folder, and nothing unfinished.
    files = list((tmp_path / "own").glob("*/*")) + list((tmp_path / "own").glob("*/.*"))
    assert len(files) == made == len(folders["own"]) == len(set(NAMES)) - 1


def test_numbered_folders_and_no_rows(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 3).alias("folder"), "id")
    assert sinks.write_folders(rows, str(tmp_path / "a"), "parquet") == 3
    assert {tuple(row) for row in spark.read.parquet(str(tmp_path / "a")).collect()} == {(i, i % 3) for i in range(30)}
    assert sinks.write_folders(rows.where("id < 0"), str(tmp_path / "b"), "json") == 0
    with pytest.raises(ValueError):
        sinks.write_folders(rows, str(tmp_path / "c"), "csv")


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("folder"), F.col("id").cast("string").alias("job_id"))
    sinks.write_folders(rows, str(tmp_path / "jobs"), "json")
    before = spark.conf.get(sources._LISTING_TASKS)
    tracker, group = spark.sparkContext.statusTracker(), "listing of folders"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = sources.object_listing(spark, str(tmp_path / "jobs"), "*.json")
        stages = [stage for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tracker.getStageInfo(stage).numTasks for stage in stages] == [4 * spark.sparkContext.defaultParallelism]
    assert found.count() == sources.job_documents(spark, str(tmp_path / "jobs")).select("job_id").distinct().count() == 200
    assert spark.conf.get(sources._LISTING_TASKS) == before
