"""Streams as a service: restarted after failures, their progress kept in a table."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query string, run string, batch long, input_rows long, metrics map<string, double>"


def supervise(start: Callable[[], StreamingQuery], restarts: int, work: Callable[[StreamingQuery], None]) -> int:
    """Start a query and do `work` with it; when it fails, start it again from its checkpoint, at most `restarts` times.

    Returns the number of restarts.  The query is stopped at the end.
    """
    for attempt in range(restarts + 1):
        query = start()
        try:
            work(query)
            return attempt
        except StreamingQueryException:
            if attempt == restarts:
                raise
        finally:
            query.stop()


def drained(query: StreamingQuery) -> None:
    """Wait until a query that runs on has processed what is there."""
    query.processAllAvailable()


class ProgressTable(StreamingQueryListener):
    """Appends a row per batch of the named queries to a table: input rows, and the counters that the stream observes."""

    def __init__(self, spark: SparkSession, path: str, names: set[str], observation: str):
        self.spark, self.path, self.names, self.observation = spark, path, names, observation
        self.ended = threading.Event()
        self._runs: set[str] = set()

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name not in self.names or not progress.numInputRows:
            return
        seen = progress.observedMetrics.get(self.observation)
        metrics = {name: float(value or 0) for name, value in seen.asDict().items()} if seen else {}
        row = (progress.name, str(progress.runId), progress.batchId, progress.numInputRows, metrics)
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        # Events come in order, so all progress is written by now.
        if str(event.runId) in self._runs:
            self.ended.set()


def with_progress(
    rows: DataFrame, counters: dict[str, Column], run: Callable[[DataFrame], StreamingQuery], path: str, name: str, timeout: float = 600
) -> DataFrame:
    """Run a named stream to its end with counters observed, and return the table of its progress.

    A batch that failed and was repeated has a row per run: the newest counts.
    """
    spark = rows.sparkSession
    listener = ProgressTable(spark, path, {name}, "counters")
    spark.streams.addListener(listener)
    try:
        query = run(rows.observe("counters", *[column.alias(key) for key, column in counters.items()]))
        query.awaitTermination()
        if not listener.ended.wait(timeout):
            raise TimeoutError(f"no end of {name} was reported within {timeout} s")
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(PROGRESS).parquet(path)
