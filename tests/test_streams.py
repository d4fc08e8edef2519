"""Windows with state, restarts and progress of streams."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from moodtide.sources.streams import table_files
from moodtide.streaming import flows, service
from moodtide.streaming.windows import keep_windows, newest_windows, with_late_rows

SCHEMA = "id long, ts timestamp, value double"


def _moment(seconds):
    return None if seconds is None else dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def _write(spark, path, rows):
    spark.createDataFrame([(i, _moment(at), value) for i, at, value in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_kept(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        stream = table_files(spark, source, schema)
        flows.finish(keep_windows(stream, "id", "ts", "value", "1 minute", path, f"{path}-checkpoint", 60, once=True), 120)

    _write(spark, source, [(1, 10, 1.0), (2, 59, 2.0), (3, 400, 5.0), (4, None, 7.0)])
    run()
    # The watermark now stands at 340 s: the first window is over, the one at 300 s is not.
    _write(spark, source, [(5, 30, 4.0), (6, 310, None), (7, 400, 1.0)])
    run()
    windows = newest_windows(spark.read.parquet(f"{path}/windows"))
    late = spark.read.parquet(f"{path}/late")
    assert {(row["id"], row["value"]) for row in late.collect()} == {(4, 7.0), (5, 4.0)}
    offset = F.unix_timestamp("window_start") - int(_moment(0).timestamp())
    assert {tuple(row) for row in windows.select(offset, "total", "valued", "n").collect()} == {(0, 3.0, 2, 2), (300, 0.0, 0, 1), (360, 6.0, 2, 2)}
    merged = with_late_rows(windows, late).where("window_start IS NOT NULL")
    assert {tuple(row) for row in merged.select(offset, "total", "n").collect()} == {(0, 7.0, 3), (300, 0.0, 1), (360, 6.0, 2)}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_a_stream_that_keeps_failing_ends(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = table_files(spark, str(tmp_path / "in"), spark.range(1).schema)
    starts = []

    def start():
        starts.append(1)

        def write(batch, batch_id):
            raise ValueError("always")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()

    with pytest.raises(StreamingQueryException):
        service.supervise(start, 2, service.drained)
    assert len(starts) == 3
