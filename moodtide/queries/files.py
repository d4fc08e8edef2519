"""Sources and sinks, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodtide.functions.jobkeys import directory_of, name_of
from moodtide.functions.stopped import second_clean
from moodtide.functions.timestamps import format_timestamp
from moodtide.operators.gate import content_gate
from moodtide.operators.records import parse_messages, tweet_messages
from moodtide.operators.registry import attach_meta
from moodtide.plans.trend import signed_series, trend
from moodtide.queries.base import (
    FIRST_TWEET_EPOCH,
    JOBS_SQL,
    TWEET_TIME_SQL,
    TWEETS_SQL,
    documents,
    gate_words_sql,
    labelled,
    message_rows,
    query,
    search_jobs,
    tweets,
)
from moodtide.queries.series import _chunks_sql
from moodtide.session import scratch_path
from moodtide.sinks import files as sinks
from moodtide.sources import files as sources
from moodtide.sources.files import table

_COUNTS = (("replies_count", 7), ("retweets_count", 11), ("likes_count", 13))
_COUNTS_SQL = ", ".join(f"(n_chars % {base})::INTEGER AS {name}" for name, base in _COUNTS)


@query(
    "roundtrip_tweets_csv",
    f"""SELECT {_COUNTS_SQL}, array_to_string(w, ' ') AS text, {TWEET_TIME_SQL} AS dt
        FROM (SELECT *, {gate_words_sql('text')} AS w FROM {TWEETS_SQL}) WHERE len(w) >= 5""",
)
def roundtrip_tweets_csv(spark, sf):
    """Gated tweets to CSV with a header, and back with types."""
    path = scratch_path(spark, "tweets-csv")
    gated = content_gate(tweets(spark, sf))
    sinks.write_tweets(
        gated.select(
            F.col("text").alias("tweet"), "datetime", *[(F.col("n_chars") % base).cast("int").alias(name) for name, base in _COUNTS]
        ),
        path,
    )
    typed = sources.typed_tweets(sources.tweets_csv(spark, path))
    return typed.withColumn("dt", format_timestamp(F.col("dt")))


@query(
    "train_csv_scan",
    f"""SELECT quality * 4 AS sentiment, doc_id AS id, {TWEET_TIME_SQL} || ' UTC' AS date, 'NO_QUERY' AS query_string, source AS "user", text
        FROM documents JOIN labels USING (doc_id)""",
)
def train_csv_scan(spark, sf):
    """Labelled rows to CSV without a header, and back; texts keep their line breaks."""
    path = scratch_path(spark, "training-csv")
    moment = F.concat(F.date_format(F.timestamp_seconds(F.lit(FIRST_TWEET_EPOCH) + F.col("doc_id") * 60), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    rows = documents(spark, sf, "doc_id", "text", "source").join(table(spark, sf, "labels"), "doc_id")
    sinks.write_training(
        rows.select(
            (F.col("quality") * 4).alias("sentiment"),
            F.col("doc_id").alias("id"),
            moment.alias("date"),
            F.lit("NO_QUERY").alias("query_string"),
            F.col("source").alias("user"),
            "text",
        ),
        path,
    )
    return sources.training_csv(spark, path, multi_line=True)


@query(
    "inferred_csv",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def inferred_csv(spark, sf):
    """Events to CSV and back with inferred types."""
    path = scratch_path(spark, "inferred-csv")
    sinks.write_clean(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    back = sources.inferred_csv(spark, path)
    return back.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", F.col("value").cast("double"))


@query("clean_csv")
def clean_csv(spark, sf):
    """Texts of the second cleaner with their target, to CSV and back."""
    path = scratch_path(spark, "clean-csv")
    target = F.when(F.col("sentiment") == 4, 1).otherwise(0).alias("target")
    cleaned = second_clean(labelled(spark, sf)).select(F.col("text_clean").alias("text"), target)
    sinks.write_clean(cleaned, path)
    return sources.inferred_csv(spark, path)


def _event_results(spark, sf, *keep):
    """Result rows of each user; errors have no time."""
    return table(spark, sf, "events").select(
        *keep,
        F.col("user_id").alias("job_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("dt"),
        F.when(F.col("value") < 30, 0.0).otherwise(4.0).alias("prediction"),
    )


_RESULTS_SQL = """(
    SELECT user_id::INTEGER AS job_id, event_id, CASE WHEN event_type = 'error' THEN 'None' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS dt,
           CASE WHEN value < 30 THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END AS prediction FROM events)"""


def _stored(spark, sf):
    path = scratch_path(spark, "results")
    sinks.store_results(_event_results(spark, sf, "event_id"), path, ["event_id"])
    return path


@query("results_roundtrip", f"SELECT job_id, dt, prediction FROM {_RESULTS_SQL}")
def results_roundtrip(spark, sf):
    """Results of all jobs in clustered files, and back."""
    return sources.rows_by_job(spark, _stored(spark, sf)).select(F.col("job_id").cast("int"), "dt", "prediction")


@query("results_of_jobs", f"SELECT job_id, dt, prediction FROM {_RESULTS_SQL} WHERE job_id % 10 = 3")
def results_of_jobs(spark, sf):
    """A tenth of the jobs, from the files that the index names."""
    path = _stored(spark, sf)
    asked = table(spark, sf, "events").select(F.col("user_id").alias("job_id")).where("job_id % 10 = 3")
    return sources.rows_by_job(spark, path, asked).select(F.col("job_id").cast("int"), "dt", "prediction")


@query(
    "results_index",
    f"SELECT job_id, count(*) AS rows, true AS few_files FROM {_RESULTS_SQL} GROUP BY job_id",
)
def results_index(spark, sf):
    """The index: rows of each job, and that there are fewer files than jobs."""
    path = _stored(spark, sf)
    index = spark.read.parquet(f"{path}/index")
    counts = index.agg(F.count_distinct("file").alias("files"), F.count_distinct("job_id").alias("jobs")).first()
    rows = index.groupBy(F.col("job_id").cast("int").alias("job_id")).agg(F.sum("rows").alias("rows"))
    return rows.withColumn("few_files", F.lit(4 * counts["files"] <= counts["jobs"]))


@query("results_exported", f"SELECT job_id, dt, prediction FROM {_RESULTS_SQL} WHERE job_id % 50 = 3")
def results_exported(spark, sf):
    """Result lines of some jobs under one folder per job, and back."""
    asked = table(spark, sf, "events").select(F.col("user_id").alias("job_id")).where("job_id % 50 = 3")
    path = scratch_path(spark, "exported")
    sinks.export_results(sources.rows_by_job(spark, _stored(spark, sf), asked), path)
    return sources.results_csv(spark, path).select(F.col("job_id").cast("int"), "dt", "prediction")


_TIMED_SQL = """(
    SELECT user_id::INTEGER AS job_id, date_trunc('second', ts) AS dt,
           arg_max(CASE WHEN value < 30 THEN -1 ELSE 1 END, event_id) AS value
    FROM events WHERE event_type <> 'error' GROUP BY ALL)"""


@query("results_trend", _chunks_sql(_TIMED_SQL, "job_id"))
def results_trend(spark, sf):
    """Stored result lines to smoothed series; the place in the file decides which value is last."""
    rows = sources.rows_by_job(spark, _stored(spark, sf)).withColumn("job_id", F.col("job_id").cast("int"))
    chunks = trend(rows, ["job_id"], seq_col="place")
    return chunks.withColumn("dt", format_timestamp(F.col("dt")))


@query(
    "jobs_json_scan",
    f"SELECT job_id, query, created_at, 2::BIGINT AS copies FROM {JOBS_SQL}",
)
def jobs_json_scan(spark, sf):
    """Job records stored in two places and read from every JSON file below the root."""
    root = scratch_path(spark, "jobs-json")
    sinks.store_jobs(search_jobs(spark, sf), f"{root}/results/jobs", f"{root}/scrap/jobs")
    found = sources.job_documents(spark, root)
    return found.groupBy("job_id", "query", "created_at").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "listing_scan",
    "SELECT DISTINCT 'c' || CAST(conv_id AS VARCHAR) AS job_id FROM conversations",
)
def listing_scan(spark, sf):
    """Jobs found by listing the staged files; no file is opened."""
    root = scratch_path(spark, "staged")
    sinks.stage_by_job(message_rows(spark, sf).select("job_config.job_id", "tweet.text"), root)
    files = sources.object_listing(spark, root, "*.parquet").where(F.col("length") > 0)
    folder = name_of(directory_of(F.col("path")))
    return files.select(F.split_part(folder, F.lit("="), F.lit(2)).alias("job_id")).distinct()


@query(
    "staged_by_job",
    "SELECT 'c' || CAST(conv_id AS VARCHAR) AS job_id, text FROM conversations",
)
def staged_by_job(spark, sf):
    """Staged rows of all jobs in clustered files."""
    root = scratch_path(spark, "staged")
    sinks.store_by_job(message_rows(spark, sf).select("job_config.job_id", "tweet.text"), root, [])
    return sources.rows_by_job(spark, root).select("job_id", "text")


@query(
    "attach_meta",
    "SELECT DISTINCT 'c' || CAST(conv_id AS VARCHAR) AS job_id, 'about ' || CAST(conv_id AS VARCHAR) AS query FROM conversations",
)
def with_meta(spark, sf):
    """Each staged tweets file with the job record that lies in the same folder."""
    root = scratch_path(spark, "siblings")
    turns = table(spark, sf, "conversations")
    job = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    sinks.write_folders(turns.select("text", job.alias("folder")), root, "parquet")
    records = turns.select(
        job.alias("folder"), job.alias("job_id"), F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("query")
    ).distinct()
    sinks.write_folders(records, root, "json")
    tweets_files = sources.object_listing(spark, root, "*.parquet").select(_bare(F.col("path")).alias("path"))
    metas = sources.job_documents(spark, root).select("job_id", "query", _bare(F.col("meta_path")).alias("meta_path"))
    return attach_meta(tweets_files, metas).select("job_id", "query").distinct()


def _bare(path):
    """Listings and file metadata spell the scheme of a local path differently."""
    return F.regexp_replace(path, "^file:/+", "/")


@query(
    "messages_roundtrip",
    f"""SELECT doc_id_text AS text, {TWEET_TIME_SQL} AS created_at, 'job' AS job_id
        FROM (SELECT doc_id, text AS doc_id_text FROM {TWEETS_SQL})""",
)
def messages_roundtrip(spark, sf):
    """Messages to JSON lines and back."""
    path = scratch_path(spark, "messages")
    pairs = tweets(spark, sf).withColumns({"job_id": F.lit("job"), "query": F.lit("any"), "created_at": F.lit(None).cast("string")})
    sinks.write_messages(tweet_messages(pairs, "text", "datetime"), path)
    parsed = parse_messages(spark.read.text(path))
    return parsed.select("tweet.text", "tweet.created_at", "job_config.job_id")


@query("signed_results", "SELECT job_id, strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt, value FROM " + _TIMED_SQL)
def signed_results(spark, sf):
    """Text results, without the untimed ones, as one signed value per time."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("int").alias("job_id"),
        F.when(F.col("event_type") == "error", "None").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("dt"),
        F.when(F.col("value") < 30, 0.0).otherwise(4.0).alias("prediction"),
        F.col("event_id").alias("seq"),
    )
    return signed_series(rows, ["job_id"]).withColumn("dt", format_timestamp(F.col("dt")))
