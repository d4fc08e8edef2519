"""Message and record shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions.timestamps import drop_zone, parse_timestamp
from moodtide.schemas import JOB_META, MESSAGE


def job_struct() -> Column:
    return F.struct("job_id", "query", "created_at")


def tweet_messages(pairs: DataFrame, text_col: str, time_col: str) -> DataFrame:
    """One nested message per tweet and job; the tweet time loses its zone name."""
    tweet = F.struct(F.col(text_col).alias("text"), drop_zone(F.col(time_col)).alias("created_at"))
    return pairs.select(tweet.alias("tweet"), job_struct().alias("job_config"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text in a single column `value`, ready for a text or message sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _readable(message: Column) -> Column:
    """A bad document parses to a struct of nulls, so the required fields are tested."""
    present = message["tweet"]["text"].isNotNull() & message["job_config"]["job_id"].isNotNull()
    return F.coalesce(present, F.lit(False))


def is_readable(value: Column) -> Column:
    return _readable(F.from_json(value.cast("string"), MESSAGE))


def parse_messages(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Nested messages from JSON text or bytes; unreadable ones are left out.

    The test sits in a one-element array, so each document is parsed once; a
    filter would be pushed below the projection and parse it again.
    """
    message = F.from_json(F.col(value_col).cast("string"), MESSAGE)
    return raw.select(F.explode(F.filter(F.array(message), _readable)).alias("m")).select("m.tweet", "m.job_config")


def decode_trigger(data: Column) -> Column:
    """A job record from its base64 payload."""
    return F.from_json(F.unbase64(data).cast("string"), JOB_META)


def replace_tweet_text(messages: DataFrame, text: Column) -> DataFrame:
    """The messages with another text in the nested record, everything else kept."""
    return messages.withColumn("tweet", F.col("tweet").withField("text", text))


def sentiment_rows(scored: DataFrame, sentiment_col: str = "prediction") -> DataFrame:
    """Output record: tweet fields on top, the job nested, the sentiment an integer."""
    job = F.struct(
        F.col("job_config.job_id").alias("job_id"),
        F.col("job_config.query").alias("query"),
        parse_timestamp(F.col("job_config.created_at")).alias("created_at"),
    )
    return scored.select(
        F.col("tweet.text").alias("text"),
        parse_timestamp(F.col("tweet.created_at")).alias("created_at"),
        F.col(sentiment_col).cast("int").alias("sentiment"),
        job.alias("job"),
    )


def result_lines(predictions: DataFrame) -> DataFrame:
    """`dt, prediction` as text; a missing time is spelled None."""
    moment = F.coalesce(F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    line = F.concat(moment, F.lit(", "), F.col("prediction").cast("string"))
    others = [name for name in predictions.columns if name not in ("dt", "prediction")]
    return predictions.select(*others, line.alias("value"))
