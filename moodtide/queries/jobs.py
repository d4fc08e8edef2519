"""Search, fan-out and the job registry."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from moodtide.functions.jobkeys import decode_job_id, directory_of, job_id_of, name_of
from moodtide.operators.gate import content_gate
from moodtide.operators.records import decode_trigger, to_json_lines, tweet_messages
from moodtide.operators.registry import (
    all_jobs,
    analysed_jobs,
    files_of_job,
    job_status,
    new_requests,
    skipped_requests,
    validate_requests,
)
from moodtide.operators.search import fan_out, in_language, match_phrases, search
from moodtide.plans.batch import run_jobs
from moodtide.plans.collecting import collect_tweets, recent_events
from moodtide.queries.base import EVENT_JOBS_SQL, JOBS_SQL, TWEETS_SQL, documents, event_jobs, gate_words_sql, query, search_jobs, tweets
from moodtide.session import scratch_path
from moodtide.sinks import files as sinks
from moodtide.sources import files as sources
from moodtide.sources.files import table
from moodtide.sources.objects import all_objects, object_contents, write_objects

_PHRASE = "that"


@query(
    "search_topn",
    f"""SELECT doc_id, text FROM documents WHERE lang = 'en' AND contains(lower(text), '{_PHRASE}')
        ORDER BY doc_id DESC LIMIT 100""",
)
def search_topn(spark, sf):
    return search(documents(spark, sf, "doc_id", "text", "lang"), _PHRASE, ["doc_id"]).select("doc_id", "text")


@query(
    "lang_phrase",
    f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND contains(lower(text), '{_PHRASE}')",
)
def lang_phrase(spark, sf):
    found = in_language(documents(spark, sf, "doc_id", "text", "lang")).where(F.contains(F.lower("text"), F.lit(_PHRASE)))
    return found.select("doc_id", "lang")


_MATCHES_SQL = f"""
    SELECT DISTINCT doc_id, lower(query) AS phrase
    FROM documents, {JOBS_SQL} WHERE contains(lower(text), lower(query))"""


@query("match_phrases", _MATCHES_SQL)
def matches(spark, sf):
    return match_phrases(documents(spark, sf, "doc_id", "text"), search_jobs(spark, sf)).select("doc_id", "phrase")


@query("match_phrases_indexed", _MATCHES_SQL)
def matches_indexed(spark, sf):
    """The way taken for many phrases: an equi-join on character runs."""
    texts = documents(spark, sf, "doc_id", "text")
    return match_phrases(texts, search_jobs(spark, sf), direct_phrases=0).select("doc_id", "phrase")


@query(
    "match_phrases_short",
    f"""SELECT doc_id, phrase FROM documents, (SELECT lower(query) AS phrase FROM {JOBS_SQL}
                                              UNION SELECT left(lower(query), 1) FROM {JOBS_SQL}) WHERE contains(lower(text), phrase)""",
)
def matches_short(spark, sf):
    """Phrases of one letter among longer ones, each looked up by runs of its own length."""
    jobs = search_jobs(spark, sf).select("query")
    both = jobs.unionByName(jobs.select(F.left(F.lower("query"), F.lit(1)).alias("query")))
    return match_phrases(documents(spark, sf, "doc_id", "text"), both, direct_phrases=0).select("doc_id", "phrase")


@query(
    "match_phrases_shuffled",
    f"""SELECT conv_id, turn, phrase FROM conversations, (SELECT DISTINCT lower(query) AS phrase FROM {JOBS_SQL})
        WHERE contains(lower(text), phrase)""",
)
def matches_shuffled(spark, sf):
    """The way taken when the phrases are too many to broadcast, over rows that share their ids."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    found = match_phrases(turns, search_jobs(spark, sf), id_col="conv_id", direct_phrases=0, broadcast_rows=-1)
    return found.select("conv_id", "turn", "phrase")


FAN_OUT_SQL = f"""
    SELECT job_id, query, created_at, doc_id, text, datetime
    FROM (SELECT j.*, t.doc_id, t.text, t.datetime,
                 row_number() OVER (PARTITION BY job_id ORDER BY doc_id DESC) AS r
          FROM {TWEETS_SQL} t, {JOBS_SQL} j
          WHERE t.lang = 'en' AND contains(lower(t.text), lower(j.query)))
    WHERE r <= 100"""


def _searched(spark, sf):
    return tweets(spark, sf).select("doc_id", "lang", "text", "datetime")


@query("job_fanout", f"SELECT job_id, query, doc_id, text FROM ({FAN_OUT_SQL})")
def job_fanout(spark, sf):
    return fan_out(_searched(spark, sf), search_jobs(spark, sf), ["doc_id"]).select("job_id", "query", "doc_id", "text")


@query(
    "collect_tweets",
    f"""SELECT job_id, doc_id, array_to_string(w, ' ') AS text
        FROM (SELECT job_id, doc_id, {gate_words_sql('text')} AS w FROM ({FAN_OUT_SQL})) WHERE len(w) >= 5""",
)
def collected(spark, sf):
    return collect_tweets(_searched(spark, sf), search_jobs(spark, sf), ["doc_id"]).select("job_id", "doc_id", "text")


@query(
    "job_messages",
    f"""SELECT array_to_string(w, ' ') AS tweet_text, strftime(strptime(left(datetime, 19), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS tweet_created_at,
               job_id, query, created_at
        FROM (SELECT *, {gate_words_sql('text')} AS w FROM ({FAN_OUT_SQL})) WHERE len(w) >= 6""",
)
def job_messages(spark, sf):
    """Messages of every job as JSON text, read back field by field."""
    pairs = content_gate(fan_out(_searched(spark, sf), search_jobs(spark, sf), ["doc_id"]), "text", 6)
    lines = to_json_lines(tweet_messages(pairs, "text", "datetime"))

    def field(path: str):
        return F.get_json_object("value", f"$.{path}")

    return lines.select(
        field("tweet.text").alias("tweet_text"),
        field("tweet.created_at").alias("tweet_created_at"),
        field("job_config.job_id").alias("job_id"),
        field("job_config.query").alias("query"),
        field("job_config.created_at").alias("created_at"),
    )


_AS_OF = "2024-01-30 23:57:12.194062"


@query(
    "age_filter",
    f"""SELECT event_id, event_type FROM events
        WHERE epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ts) <= 1296000000000""",
)
def age_filter(spark, sf):
    """Events no older than fifteen days before the newest one at the smallest scale."""
    fresh = recent_events(table(spark, sf, "events"), "ts", 15 * 86400.0, F.lit(_AS_OF))
    return fresh.select("event_id", "event_type")


def _object_paths(spark, sf):
    """Paths as an object store lists them; jobs of even users have encoded names."""
    encoded = F.concat(F.lit("base64:"), F.base64(F.encode("job_id", "UTF-8")))
    name = F.when(F.col("user_id") % 2 == 0, encoded).otherwise(F.col("job_id"))
    return event_jobs(spark, sf).select("job_id", F.concat(F.lit("jobs/"), name, F.lit("/"), name_of(F.col("path"))).alias("path"))


_PATHS_SQL = f"""(
    SELECT job_id, 'jobs/' || CASE WHEN user_id % 2 = 0 THEN 'base64:' || base64(encode(job_id)) ELSE job_id END
           || '/' || string_split(path, '/')[3] AS path
    FROM {EVENT_JOBS_SQL})"""


@query(
    "jobs_union",
    f"""SELECT DISTINCT job_id AS name, 'b' AS kind FROM {_PATHS_SQL}
        UNION SELECT query, 's' FROM {JOBS_SQL}""",
)
def jobs_union(spark, sf):
    return all_jobs(_object_paths(spark, sf), search_jobs(spark, sf))


@query(
    "decode_job_ids",
    f"""SELECT path, CASE WHEN starts_with(p, 'base64:') THEN decode(from_base64(substr(p, 8))) ELSE p END AS job_id
        FROM (SELECT path, string_split(path, '/')[2] AS p FROM {_PATHS_SQL})""",
)
def decode_job_ids(spark, sf):
    return _object_paths(spark, sf).select("path", decode_job_id(job_id_of(F.col("path"))).alias("job_id"))


@query(
    "path_predicates",
    f"""SELECT path, string_split(path, '/')[2] AS job_id, 'jobs/' || string_split(path, '/')[2] AS directory,
               ends_with(path, '/meta.json') AS is_meta, ends_with(path, '.csv') AS is_csv,
               starts_with(path, 'jobs/u1') AS prefix_u1, starts_with(path, 'jobs/u1-') AS exact_u1
        FROM {EVENT_JOBS_SQL}""",
)
def path_predicates(spark, sf):
    path = F.col("path")
    return event_jobs(spark, sf).select(
        "path",
        job_id_of(path).alias("job_id"),
        directory_of(path).alias("directory"),
        F.endswith(path, F.lit("/meta.json")).alias("is_meta"),
        F.endswith(path, F.lit(".csv")).alias("is_csv"),
        F.startswith(path, F.lit("jobs/u1")).alias("prefix_u1"),
        F.startswith(path, F.lit("jobs/u1-")).alias("exact_u1"),
    )


@query("files_of_job", f"SELECT event_id, path FROM {EVENT_JOBS_SQL} WHERE starts_with(path, 'jobs/u1')")
def one_job(spark, sf):
    """The prefix listing, which also takes jobs whose name goes on."""
    return files_of_job(event_jobs(spark, sf).select("event_id", "path"), "u1", exact=False)


def _known_jobs(spark, sf):
    """Jobs with files, and conversations that never left one."""
    with_files = event_jobs(spark, sf).select("job_id")
    without = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("job_id"))
    return with_files.unionByName(without).distinct()


_STATUS_SQL = f"""(
    SELECT j.job_id, CASE WHEN bool_or(ends_with(path, '/_error')) THEN 'error'
                          WHEN bool_or(ends_with(path, '/results.csv')) THEN 'done'
                          WHEN count(path) > 0 THEN 'in_progress' ELSE 'missing' END AS status
    FROM (SELECT job_id FROM {EVENT_JOBS_SQL} UNION SELECT 'c' || CAST(conv_id AS VARCHAR) FROM conversations) j
    LEFT JOIN {EVENT_JOBS_SQL} f ON j.job_id = f.job_id GROUP BY j.job_id)"""


@query("job_status", f"SELECT * FROM {_STATUS_SQL}")
def statuses(spark, sf):
    return job_status(_known_jobs(spark, sf), event_jobs(spark, sf).select("path"))


@query("job_status_from_files", f"SELECT * FROM {_STATUS_SQL}")
def stored_statuses(spark, sf):
    """The same from a stored table of artefacts, without markers, and the table of failures."""
    listed, failed = scratch_path(spark, "artefacts"), scratch_path(spark, "failures")
    found = event_jobs(spark, sf)
    found.where("event_type <> 'error' OR event_type IS NULL").select("path").distinct().write.parquet(listed)
    errors = found.where("event_type = 'error'").select("job_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))
    sinks.store_failures(errors, failed)
    return job_status(_known_jobs(spark, sf), spark.read.schema("path string").parquet(listed), sources.failures(spark, failed))


@query("job_status_listed", f"SELECT * FROM {_STATUS_SQL}")
def listed_statuses(spark, sf):
    """The same from real objects below a folder: written by tasks, some markers by failing work, all listed by tasks."""
    root = scratch_path(spark, "store")
    found = event_jobs(spark, sf).select("job_id", "path", "event_type").distinct()
    failing = found.where("event_type = 'error'").select("job_id").distinct()
    # A few jobs fail on the driver; the markers of the others are written by the tasks.
    few = [row["job_id"] for row in failing.orderBy("job_id").limit(5).collect()]
    paths = found.where(~((F.col("event_type") == "error") & F.col("job_id").isin(few))).select("path").distinct()
    write_objects(paths.select("path", F.lit("a line").alias("line")), root)
    for job_id in few:
        with contextlib.suppress(ZeroDivisionError):
            sinks.marking_failure(root, job_id, lambda: 1 / 0)
    return job_status(_known_jobs(spark, sf), all_objects(spark, root).select("path"))


@query(
    "batch_job_flow",
    f"""SELECT j.job_id, CASE WHEN e.error IS NOT NULL OR t.n IS NULL THEN 'error' ELSE 'done' END AS status,
               CASE WHEN e.error IS NULL AND t.n IS NOT NULL THEN t.n + 1 ELSE 0 END AS tweet_lines,
               CASE WHEN e.error IS NULL THEN coalesce(t.n, 0) ELSE 0 END AS result_lines,
               CASE WHEN e.error IS NOT NULL THEN e.error WHEN t.n IS NULL THEN 'No tweets were found.' END AS reason
        FROM {JOBS_SQL} j
        JOIN (SELECT job_id, CASE WHEN length(query) <= 3 THEN 'Word should have more than 4 characters.'
                     WHEN NOT regexp_matches(query, '^[a-zA-Z\\d!\\s@#$^&*()_+"|}}{{?><~]*$') THEN 'String includes invalid characters.' END AS error
              FROM {JOBS_SQL}) e USING (job_id)
        LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT job_id, {gate_words_sql('text')} AS w FROM ({FAN_OUT_SQL}))
                   WHERE len(w) >= 5 GROUP BY job_id) t USING (job_id)""",
)
def batch_job_flow(spark, sf):
    """Search jobs from request to stored results: states, and what lies in their objects."""
    root = scratch_path(spark, "store")
    # A word count stands in for the model: the lines do not depend on it.
    def score(rows):
        return rows.withColumn("prediction", F.when(F.length("text") % 2 == 0, 0.0).otherwise(4.0))

    status = run_jobs(_searched(spark, sf), search_jobs(spark, sf), score, root, ["doc_id"])
    contents = object_contents(spark, root).select(
        job_id_of(F.col("path")).alias("job_id"), name_of(F.col("path")).alias("name"), F.decode("content", "UTF-8").alias("text")
    )

    def lines(name: str):
        breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
        return F.coalesce(F.max(F.when(F.col("name") == name, breaks)), F.lit(0)).cast("bigint")

    held = contents.groupBy("job_id").agg(
        lines("tweets.csv").alias("tweet_lines"),
        lines("results.csv").alias("result_lines"),
        F.max(F.when(F.col("name") == "_error", F.rtrim(F.replace("text", F.lit("\n"), F.lit(" "))))).alias("reason"),
    )
    return status.join(held, "job_id").select("job_id", "status", "tweet_lines", "result_lines", "reason")


def _requests(spark, sf):
    """One request per event and per conversation turn."""
    kind = F.when(F.col("event_type") == "view", "stream").otherwise("batch")
    asked = event_jobs(spark, sf).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), F.col("job_id").alias("query"), kind.alias("job_type")
    )
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("query"),
        F.lit("batch").alias("job_type"),
    )
    return asked.unionByName(turns)


def _analysed(spark, sf):
    done = analysed_jobs(event_jobs(spark, sf).select("path"))
    return done.select(F.col("job_id").alias("query"), F.lit("batch").alias("job_type"))


_REQUESTS_SQL = f"""(
    SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, job_id AS query,
           CASE WHEN event_type = 'view' THEN 'stream' ELSE 'batch' END AS job_type FROM {EVENT_JOBS_SQL}
    UNION ALL SELECT 'c-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'c' || CAST(conv_id AS VARCHAR), 'batch'
    FROM conversations)"""

_ANALYSED_SQL = f"(SELECT job_id FROM {_STATUS_SQL} WHERE status IN ('done', 'in_progress'))"


@query(
    "new_jobs",
    f"SELECT * FROM {_REQUESTS_SQL} WHERE NOT (job_type = 'batch' AND query IN {_ANALYSED_SQL})",
)
def unanswered(spark, sf):
    return new_requests(_requests(spark, sf), _analysed(spark, sf)).select("request_id", "query", "job_type")


@query("skip_done", f"SELECT * FROM {_REQUESTS_SQL} WHERE job_type = 'batch' AND query IN {_ANALYSED_SQL}")
def answered(spark, sf):
    return skipped_requests(_requests(spark, sf), _analysed(spark, sf)).select("request_id", "query", "job_type")


@query(
    "validate_query",
    r"""SELECT conv_id, turn,
               CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 100 THEN 'Number of words should be less than 100.'
                    WHEN length(text) <= 3 THEN 'Word should have more than 4 characters.'
                    WHEN NOT regexp_matches(text, '^[a-zA-Z\d!\s@#$^&*()_+"|}{?><~]*$') THEN 'String includes invalid characters.'
                    WHEN role NOT IN ('user', 'assistant') THEN 'Job type is invalid value.' END AS error
        FROM conversations""",
)
def validate(spark, sf):
    kind = F.when(F.col("role") == "user", "batch").when(F.col("role") == "assistant", "stream").otherwise(F.col("role"))
    requests = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"), kind.alias("job_type"))
    return validate_requests(requests).select("conv_id", "turn", "error")


@query(
    "message_decode",
    f"""SELECT job_id, query, created_at FROM {JOBS_SQL}""",
)
def triggers(spark, sf):
    """Job records through their base64 payload."""
    payload = F.base64(F.encode(F.to_json(F.struct("job_id", "query", "created_at")), "UTF-8"))
    return search_jobs(spark, sf).select(decode_trigger(payload).alias("job")).select("job.*")
