"""Streaming queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from moodtide.functions.cleaning import clean_text
from moodtide.functions.timestamps import within_age
from moodtide.operators.gate import STREAM_MIN_WORDS, content_gate
from moodtide.operators.records import is_readable, parse_messages, replace_tweet_text, sentiment_rows, tweet_messages
from moodtide.operators.search import TWEETS_LIMIT, fan_out

# Fixed values, needed for equal results.
WINDOW_SECONDS = 10

WINDOW = f"{WINDOW_SECONDS} seconds"


def clean_messages(raw: DataFrame) -> DataFrame:
    """Parsed messages with their text cleaned; unreadable ones are left out."""
    return replace_tweet_text(parse_messages(raw), clean_text(F.col("tweet.text")))


def unreadable_messages(raw: DataFrame) -> DataFrame:
    """The messages `clean_messages` leaves out, for an error table."""
    return raw.where(~is_readable(F.col("value")))


def score_messages(messages: DataFrame, model: PipelineModel) -> DataFrame:
    """Add a prediction to each message, with the model of the batch jobs."""
    return model.transform(messages.withColumn("text", F.col("tweet.text"))).select(
        "tweet", "job_config", "prediction"
    )


def sentiment_stream(raw: DataFrame, model: PipelineModel) -> DataFrame:
    """Messages in, nested sentiment rows out."""
    return sentiment_rows(score_messages(clean_messages(raw), model))


def fresh_events(events: DataFrame, time_col: str, max_age: float, as_of: Column | None = None) -> DataFrame:
    """Drop events older than `max_age` seconds when they are processed, or at the time `as_of`."""
    return events.where(within_age(F.col(time_col), max_age, as_of))


def tag_window(rows: DataFrame, time_col: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Each row with the start of its window.

    Nothing is aggregated, so rows without a time stay, with a null window;
    the built-in window function would drop them.
    """
    epoch = F.col(time_col).cast("timestamp").cast("double")
    return rows.withColumn("window_start", F.timestamp_seconds(F.floor(epoch / seconds) * seconds))


def _started(writer: DataStreamWriter, checkpoint: str, once: bool, interval: str) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def append_to_files(
    rows: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = WINDOW
) -> StreamingQuery:
    """Append rows to a parquet table; the checkpoint makes each row land exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return _started(writer, checkpoint, once, interval).start()


def append_to_table(
    rows: DataFrame, table: str, checkpoint: str, once: bool = False, interval: str = WINDOW
) -> StreamingQuery:
    """The same into a catalog table, created on first use."""
    writer = rows.writeStream.outputMode("append")
    return _started(writer, checkpoint, once, interval).toTable(table)


def append_window_parts(
    rows: DataFrame,
    time_col: str,
    value_col: str,
    path: str,
    checkpoint: str,
    seconds: int = WINDOW_SECONDS,
    once: bool = False,
    interval: str = WINDOW,
) -> StreamingQuery:
    """Write the sum and count of each window and batch.

    No state is kept, so no row is ever too late; a repeated batch overwrites
    its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        timed = tag_window(batch.where(F.col(time_col).isNotNull()), time_col, seconds)
        parts = timed.groupBy("window_start").agg(F.sum(value_col).alias("total"), F.count(value_col).alias("valued"), F.count(F.lit(1)).alias("n"))
        parts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(rows.writeStream.foreachBatch(write), checkpoint, once, interval).start()


def merged_windows(parts: DataFrame) -> DataFrame:
    """Mean and count of each window over all batches."""
    return parts.groupBy("window_start").agg(
        F.try_divide(F.sum("total"), F.sum("valued")).alias("mean_value"), F.sum("n").alias("n")
    )


def fan_out_stream(
    tweets: DataFrame,
    jobs: DataFrame,
    newest_first: list[str],
    path: str,
    checkpoint: str,
    limit: int = TWEETS_LIMIT,
    min_words: int = STREAM_MIN_WORDS,
    time_col: str = "datetime",
    id_col: str = "doc_id",
    once: bool = False,
    interval: str = WINDOW,
) -> StreamingQuery:
    """Every job against each batch of arriving tweets, gated, as messages.

    The limit holds per batch, as it holds per trigger, so the rows depend on the batches.  A batch that is
    repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = fan_out(batch, jobs, newest_first, limit, id_col=id_col)
        messages = tweet_messages(content_gate(found, "text", min_words), "text", time_col)
        messages.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = tweets.writeStream.foreachBatch(write)
    return _started(writer, checkpoint, once, interval).start()


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Block until the query ends, however long unless told otherwise, and raise what made it fail."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not end within {timeout} s")
    if query.exception():
        raise query.exception()
