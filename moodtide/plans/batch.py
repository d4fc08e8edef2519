"""The batch job on real objects: every job leaves its files, and a failed one its marker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions.jobkeys import query_error
from moodtide.functions.timestamps import drop_zone
from moodtide.operators.gate import BATCH_MIN_WORDS
from moodtide.operators.records import result_lines
from moodtide.operators.registry import ERROR_FILE, META_FILE, RESULTS_FILE, TWEETS_FILE, job_status
from moodtide.operators.search import TWEETS_LIMIT
from moodtide.plans.collecting import collect_tweets
from moodtide.sinks.files import keep
from moodtide.sources.objects import all_objects, write_objects

NOTHING_FOUND = "No tweets were found."


def object_path(job_id: Column, name: str) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit(f"/{name}"))


def _tweet_lines(collected: DataFrame, time_col: str, order_by: list[str]) -> DataFrame:
    """Lines of each job's tweets file, the header first."""
    header = collected.select("job_id").distinct().select("job_id", F.lit(0).alias("body"), F.lit("tweet,datetime").alias("line"))
    row = F.to_csv(F.struct(F.col("text").alias("tweet"), F.col(time_col).alias("datetime")), {"escape": '"'})
    body = collected.select("job_id", F.lit(1).alias("body"), *order_by, row.alias("line"))
    both = body.unionByName(header, allowMissingColumns=True)
    return both.select(object_path(F.col("job_id"), TWEETS_FILE).alias("path"), "body", *order_by, "line")


def run_jobs(
    tweets: DataFrame,
    jobs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    root: str,
    newest_first: list[str],
    limit: int = TWEETS_LIMIT,
    min_words: int = BATCH_MIN_WORDS,
    time_col: str = "datetime",
    id_col: str = "doc_id",
) -> DataFrame:
    """Search, collect, score and store every job below `root`/jobs, and tell the state of each from what is there.

    Each job leaves meta.json, tweets.csv and results.csv; a request that is not valid, or finds nothing,
    leaves an error marker with the reason instead of results.  A job's files hold at most `limit` rows.  Steps
    are written before the next one reads them, so a repeated run overwrites the same objects.
    """
    named = keep(jobs.select("job_id", "query", "created_at"), "jobs")
    record = F.to_json(F.struct("job_id", "query", "created_at"))
    write_objects(named.select(object_path(F.col("job_id"), META_FILE).alias("path"), record.alias("line")), root)
    asked = named.withColumn("error", query_error(F.col("query")))
    collected = keep(
        collect_tweets(tweets, asked.where("error IS NULL").drop("error"), newest_first, limit, min_words, id_col=id_col), "collected"
    )
    write_objects(_tweet_lines(collected, time_col, newest_first), root, ["body", *newest_first])
    scored = score(collected).select("job_id", *newest_first, drop_zone(F.col(time_col)).cast("timestamp").alias("dt"), "prediction")
    lines = result_lines(scored).select(object_path(F.col("job_id"), RESULTS_FILE).alias("path"), *newest_first, F.col("value").alias("line"))
    write_objects(lines, root, newest_first)
    found = collected.select("job_id").distinct().withColumn("found", F.lit(True))
    reason = F.coalesce("error", F.when(F.col("found").isNull(), NOTHING_FOUND))
    failed = asked.join(found, "job_id", "left").select(object_path(F.col("job_id"), ERROR_FILE).alias("path"), reason.alias("line"))
    write_objects(failed.where("line IS NOT NULL"), root)
    return keep(job_status(named.select("job_id"), all_objects(named.sparkSession, root).select("path")), "status")
