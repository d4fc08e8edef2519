"""Windows kept in the state store, with a table of the rows that come too late for them.

A window is dropped from the state once the watermark has passed its end.  Spark's own
windowed aggregate drops the rows that come after that without a trace; here
they are told apart by the same watermark and stored, so that no row is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moodtide.streaming.flows import WINDOW, _started

_OUT = "late boolean, window_start timestamp, total double, valued long, n long, id long, at timestamp"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STATE = "total double, valued long, n long"


def _updater(seconds: int):
    """New sums of one window, or its rows if the window is over."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = key[0]
        # The watermark is 0 until the first batch with times has ended.
        is_over = pd.isnull(start) or int(start.timestamp() * 1000) + seconds * 1000 <= state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            if is_over:
                state.remove()
            else:
                state.setTimeoutDuration(1)
            return
        total, valued, n = state.get if state.exists else (0.0, 0, 0)
        for rows in batches:
            if is_over:
                yield pd.DataFrame(
                    {"late": True, "window_start": start, "total": rows["value"], "valued": rows["value"].notna().astype(int), "n": 1, "id": rows["id"], "at": rows["at"]}
                )
            else:
                total, valued, n = total + float(rows["value"].sum()), valued + int(rows["value"].notna().sum()), n + len(rows)
        if not is_over:
            state.update((total, valued, n))
            # Asked again with the next batch, whether the window is over.
            state.setTimeoutDuration(1)
            yield pd.DataFrame({"late": [False], "window_start": [start], "total": [total], "valued": [valued], "n": [n], "id": [None], "at": [None]})

    return update


def keep_windows(
    rows: DataFrame,
    id_col: str,
    time_col: str,
    value_col: str,
    lateness: str,
    path: str,
    checkpoint: str,
    seconds: int,
    once: bool = False,
    interval: str = WINDOW,
) -> StreamingQuery:
    """Sum and count per window, in state; `path`/windows gets every new version, `path`/late the rows that came too late.

    Rows without a time have no window and go to the late table, too.  A batch that is repeated overwrites its own folders.
    """
    at = F.col(time_col).cast("timestamp")
    timed = rows.select(F.col(id_col).cast("bigint").alias("id"), at.alias("at"), F.col(value_col).cast("double").alias("value"))
    start = F.timestamp_seconds(F.floor(F.col("at").cast("double") / seconds) * seconds)
    marked = timed.withColumn("window_start", start).withWatermark("at", lateness)
    kept = marked.groupBy("window_start").applyInPandasWithState(
        _updater(seconds), _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        windows = batch.where(~F.col("late")).select("window_start", "total", "valued", "n")
        windows.write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
        late = batch.where("late").select("id", "at", F.col("total").alias("value"), "window_start")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.unpersist()

    writer = _started(kept.writeStream.outputMode("update").foreachBatch(write), checkpoint, once, interval)
    # Timeouts are looked at when rows arrive; batches for their sake alone would never end a drained stream.
    conf = rows.sparkSession.conf
    before = conf.get(_EMPTY_BATCHES)
    conf.set(_EMPTY_BATCHES, "false")
    try:
        return writer.start()
    finally:
        conf.set(_EMPTY_BATCHES, before)


def newest_windows(versions: DataFrame) -> DataFrame:
    """The last written version of each window."""
    last = F.max_by(F.struct("total", "valued", "n"), "batch").alias("last")
    return versions.groupBy("window_start").agg(last).select("window_start", "last.*")


def with_late_rows(windows: DataFrame, late: DataFrame) -> DataFrame:
    """Windows as they would be had no row come too late."""
    sums = late.groupBy("window_start").agg(F.sum("value").alias("total"), F.count("value").alias("valued"), F.count(F.lit(1)).alias("n"))
    both = windows.select("window_start", "total", "valued", "n").unionByName(sums)
    return both.groupBy("window_start").agg(F.sum("total").alias("total"), F.sum("valued").alias("valued"), F.sum("n").alias("n"))
