"""Streaming queries: each drains its input, stops, and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodtide.functions.timestamps import format_timestamp
from moodtide.operators.records import parse_messages, sentiment_rows, to_json_lines
from moodtide.queries.base import JOBS_SQL, MESSAGES_SQL, TWEETS_SQL, clean_sql, gate_words_sql, message_rows, query, search_jobs, tweets
from moodtide.queries.model import fitted
from moodtide.session import scratch_path
from moodtide.sinks.files import write_messages
from moodtide.sources.files import load_model, table
from moodtide.sources.streams import message_files, table_files
from moodtide.streaming import flows
from moodtide.streaming.service import drained, supervise, with_progress
from moodtide.streaming.windows import keep_windows, newest_windows, with_late_rows


def _arriving(spark, sf):
    """Conversation turns as a stream of JSON messages."""
    path = scratch_path(spark, "topic")
    write_messages(message_rows(spark, sf), path)
    return message_files(spark, path)


def _drained(spark, rows, label):
    path = scratch_path(spark, label)
    flows.finish(flows.append_to_files(rows, path, f"{path}-checkpoint", once=True))
    return spark.read.parquet(path)


@query("stream_messages", f"SELECT text, created_at, job_id, query, job_created_at FROM {MESSAGES_SQL}")
def stream_messages(spark, sf):
    """Messages parsed on arrival."""
    parsed = parse_messages(_arriving(spark, sf)).select(
        "tweet.text", "tweet.created_at", "job_config.job_id", "job_config.query", F.col("job_config.created_at").alias("job_created_at")
    )
    return _drained(spark, parsed, "parsed")


@query(
    "stream_clean_append",
    f"""SELECT {clean_sql('text')} AS text, created_at, (length(query) % 2 * 4)::INTEGER AS sentiment, job_id, query, job_created_at
        FROM {MESSAGES_SQL}""",
)
def stream_clean_append(spark, sf):
    """Messages cleaned, shaped and appended, with a rule in place of the model."""
    cleaned = flows.clean_messages(_arriving(spark, sf))
    rows = sentiment_rows(cleaned.withColumn("prediction", F.length("job_config.query") % 2 * 4))
    return _drained(spark, rows, "appended").select(
        "text",
        format_timestamp(F.col("created_at")).alias("created_at"),
        "sentiment",
        "job.job_id",
        "job.query",
        format_timestamp(F.col("job.created_at")).alias("job_created_at"),
    )


@query("stream_predict")
def stream_predict(spark, sf):
    """Messages scored with the stored model of the batch jobs."""
    root, _, _ = fitted(spark, sf)
    rows = flows.sentiment_stream(_arriving(spark, sf), load_model(root))
    return _drained(spark, rows, "scored")


@query(
    "stream_predict_checked",
    f"""SELECT {clean_sql('text')} AS text, created_at, job_id, query, job_created_at, true AS same FROM {MESSAGES_SQL}""",
)
def stream_predict_checked(spark, sf):
    """Streamed rows, and whether each has the sentiment that scoring the turns as a batch gives its text."""
    root, _, _ = fitted(spark, sf)
    batch = flows.clean_messages(to_json_lines(message_rows(spark, sf))).select(F.col("tweet.text").alias("text")).distinct()
    scored = load_model(root).transform(batch).select(F.col("text").alias("batch_text"), F.col("prediction").cast("int").alias("expected"))
    rows = stream_predict(spark, sf)
    return rows.join(scored, F.col("text") == F.col("batch_text"), "left").select(
        "text",
        format_timestamp(F.col("created_at")).alias("created_at"),
        "job.job_id",
        "job.query",
        format_timestamp(F.col("job.created_at")).alias("job_created_at"),
        F.coalesce(F.col("sentiment") == F.col("expected"), F.lit(False)).alias("same"),
    )


@query("stream_unreadable", f"SELECT job_id || ':' || text AS value FROM {MESSAGES_SQL} WHERE query = 'user'")
def stream_unreadable(spark, sf):
    """Messages that cannot be read go to a table of their own, unchanged; here those of one role are no JSON."""
    path = scratch_path(spark, "topic")
    good = F.to_json(F.struct("tweet", "job_config"))
    broken = F.concat_ws(":", "job_config.job_id", "tweet.text")
    bad = F.col("job_config.query") == "user"
    # A table, because a message may hold line breaks.
    message_rows(spark, sf).select(F.when(bad, broken).otherwise(good).alias("value")).write.parquet(path)
    arriving = table_files(spark, path, spark.read.parquet(path).schema)
    return _drained(spark, flows.unreadable_messages(arriving).select("value"), "unreadable")


_WINDOW_SQL = "strftime(to_timestamp(floor(epoch(ts) / 10) * 10) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


def _event_stream(spark, sf):
    # A pattern, because a stream takes a single file only as the match of one.
    return table_files(spark, f"{sf}/{{events}}.parquet", table(spark, sf, "events").schema)


@query(
    "stream_window10s",
    f"""SELECT {_WINDOW_SQL} AS window_start, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_window10s(spark, sf):
    """Mean value of each ten seconds, over files that arrive out of order in several batches."""
    source, path = scratch_path(spark, "events"), scratch_path(spark, "windows")
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    events.repartition(6, F.col("event_id") % 6).write.parquet(source)
    stream = table_files(spark, source, events.schema, 2)
    flows.finish(flows.append_window_parts(stream, "ts", "value", path, f"{path}-checkpoint", once=True))
    newest = flows.merged_windows(spark.read.parquet(path))
    return newest.select(format_timestamp(F.col("window_start")).alias("window_start"), F.round("mean_value", 6).alias("mean_value"), "n")


@query("stream_tag_window", f"SELECT event_id, {_WINDOW_SQL} AS window_start FROM events")
def stream_tag_window(spark, sf):
    """Each event with its window, nothing aggregated."""
    tagged = flows.tag_window(_event_stream(spark, sf), "ts").select("event_id", "window_start")
    return _drained(spark, tagged, "tagged").withColumn("window_start", format_timestamp(F.col("window_start")))


@query(
    "stream_fresh_events",
    "SELECT event_id FROM events WHERE (SELECT max(epoch(ts)) FROM events) - epoch(ts) <= 864000",
)
def stream_fresh_events(spark, sf):
    """Events no older than ten days at the time of the last one."""
    last = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp").cast("double")).alias("at")).first()["at"]
    as_of = F.timestamp_seconds(F.lit(last or 0.0))
    fresh = flows.fresh_events(_event_stream(spark, sf), "ts", 864000.0, as_of)
    return _drained(spark, fresh.select("event_id"), "fresh")


@query(
    "stream_fanout",
    f"""SELECT array_to_string(w, ' ') AS text, left(datetime, 19) AS created_at, job_id, query
        FROM (SELECT *, {gate_words_sql('text')} AS w
              FROM (SELECT j.job_id, j.query, t.text, t.datetime,
                           row_number() OVER (PARTITION BY job_id ORDER BY doc_id DESC) AS r
                    FROM {TWEETS_SQL} t, {JOBS_SQL} j
                    WHERE t.lang = 'en' AND contains(lower(t.text), lower(j.query)))
              WHERE r <= 100)
        WHERE len(w) >= 6""",
)
def stream_fanout(spark, sf):
    """Every job against the arriving tweets; all files make one batch here."""
    source, path = scratch_path(spark, "tweets"), scratch_path(spark, "fanned")
    rows = tweets(spark, sf).select("doc_id", "lang", "text", "datetime")
    rows.write.parquet(source)
    arriving = table_files(spark, source, rows.schema)
    flows.finish(
        flows.fan_out_stream(arriving, search_jobs(spark, sf), ["doc_id"], path, f"{path}-checkpoint", once=True)
    )
    return spark.read.parquet(path).select("tweet.text", "tweet.created_at", "job_config.job_id", "job_config.query")


_HOUR_SQL = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"


def _event_files(spark, sf, files, per_batch):
    """Events in files that each span all times, so that later batches bring late rows."""
    source = scratch_path(spark, "events")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    events.repartition(files, F.col("event_id") % files).write.parquet(source)
    return table_files(spark, source, events.schema, per_batch)


@query(
    "stream_window_state",
    f"""SELECT {_HOUR_SQL} AS window_start, round(sum(value), 4) AS total, count(*) AS n,
               (SELECT count(*) FROM events) AS all_rows, true AS some_late FROM events GROUP BY ALL""",
)
def stream_window_state(spark, sf):
    """Hours kept in the state store: rows in time and late rows together are all rows."""
    path = scratch_path(spark, "state")
    arriving = _event_files(spark, sf, 6, 2)
    flows.finish(keep_windows(arriving, "event_id", "ts", "value", "2 days", path, f"{path}-checkpoint", 3600, once=True))
    windows, late = newest_windows(spark.read.parquet(f"{path}/windows")), spark.read.parquet(f"{path}/late")
    counts = windows.agg(F.sum("n")).first()[0], late.count()
    rows = with_late_rows(windows, late)
    return rows.select(
        format_timestamp(F.col("window_start")).alias("window_start"),
        F.round("total", 4).alias("total"),
        "n",
        F.lit(sum(counts)).cast("bigint").alias("all_rows"),
        F.lit(counts[1] > 0).alias("some_late"),
    )


@query("stream_restarted", "SELECT event_id, event_type, 1 AS restarts FROM events")
def stream_restarted(spark, sf):
    """A stream that runs on by the clock, fails in its second batch, and goes on from its checkpoint: each row once."""
    path = scratch_path(spark, "restarted")
    arriving = _event_files(spark, sf, 6, 2).select("event_id", "event_type")
    failed = []

    def write(batch, batch_id):
        if batch_id == 1 and not failed:
            # Half of the batch is there when the stream fails.
            batch.where("event_id % 2 = 0").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            failed.append(batch_id)
            raise RuntimeError("the second batch fails")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    def start():
        writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint")
        return writer.trigger(processingTime="200 milliseconds").start()

    restarts = supervise(start, 3, drained)
    return spark.read.parquet(path).select("event_id", "event_type", F.lit(restarts).alias("restarts"))


@query(
    "stream_progress",
    """SELECT CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) AS DOUBLE) AS rows,
              CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS purchases,
              CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS errors, true AS several_batches FROM events""",
)
def stream_progress(spark, sf):
    """Counters of each batch, kept by a listener, add up to the input."""
    path = scratch_path(spark, "progress")
    name = path.rsplit("/", 1)[-1]

    def run(rows):
        writer = rows.writeStream.queryName(name).format("parquet").option("path", f"{path}-rows")
        return writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()

    kind = F.col("event_type")
    counters = {
        "rows": F.count(F.lit(1)),
        "purchases": F.count_if(kind == "purchase"),
        "errors": F.count_if(kind == "error"),
    }
    progress = with_progress(_event_files(spark, sf, 6, 2), counters, run, path, name)
    sums = [F.sum(F.col("metrics")[key]).alias(key) for key in counters]
    return progress.agg(F.sum("input_rows").alias("input_rows"), *sums, (F.count(F.lit(1)) > 1).alias("several_batches"))
