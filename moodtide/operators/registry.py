"""Job registry: which jobs exist, what state they are in, which requests are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.functions.jobkeys import decode_job_id, directory_of, job_id_of, job_type_error, query_error

# Names of the files a job leaves behind.
META_FILE = "meta.json"
TWEETS_FILE = "tweets.csv"
RESULTS_FILE = "results.csv"
ERROR_FILE = "_error"


def all_jobs(batch_paths: DataFrame, stream_jobs: DataFrame) -> DataFrame:
    """Names of batch jobs (from object paths) and queries of stream jobs, tagged and distinct."""
    batch = batch_paths.select(decode_job_id(job_id_of(F.col("path"))).alias("name"), F.lit("b").alias("kind"))
    stream = stream_jobs.select(F.col("query").alias("name"), F.lit("s").alias("kind"))
    return batch.unionByName(stream).distinct()


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with the first failing check as `error`; valid ones have none."""
    error = F.coalesce(query_error(F.col("query")), job_type_error(F.col("job_type")))
    return requests.withColumn("error", error)


def new_requests(requests: DataFrame, analysed: DataFrame) -> DataFrame:
    """Requests that no error-free job has answered yet."""
    return requests.join(analysed, ["query", "job_type"], "left_anti")


def skipped_requests(requests: DataFrame, analysed: DataFrame) -> DataFrame:
    return requests.join(analysed, ["query", "job_type"], "left_semi")


def files_of_job(paths: DataFrame, query: str, exact: bool = True) -> DataFrame:
    """Objects of one job.  `exact=False` also takes jobs whose name only begins with the query."""
    prefix = f"jobs/{query}/" if exact else f"jobs/{query}"
    return paths.where(F.startswith(F.col("path"), F.lit(prefix)))


def artefacts_by_job(paths: DataFrame) -> DataFrame:
    """One row per job with the files found in its directory; encoded names are decoded, as in `all_jobs`."""

    def has(name: str):
        return F.coalesce(F.max(F.endswith(F.col("path"), F.lit("/" + name))), F.lit(False))

    return paths.groupBy(decode_job_id(job_id_of(F.col("path"))).alias("job_id")).agg(
        has(META_FILE).alias("has_meta"),
        has(RESULTS_FILE).alias("has_results"),
        has(ERROR_FILE).alias("has_error"),
    )


def _found(paths: DataFrame, failures: DataFrame | None) -> DataFrame:
    """Artefacts of each job, with failures from their own table taken in."""
    found = artefacts_by_job(paths)
    if failures is None:
        return found
    # One row per job and side, so the join needs no second look at the files.
    failed = failures.groupBy("job_id").agg(F.lit(True).alias("failed"))
    has_error = F.coalesce("failed", F.lit(False)) | F.coalesce("has_error", F.lit(False))
    return found.join(failed, "job_id", "full").withColumn("has_error", has_error)


def job_status(jobs: DataFrame, paths: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """State of each job: error, done, in_progress, or missing when it left no file.

    Listings by Spark leave out names that begin with an underscore, as error
    markers do, so failures come from their own table; `paths` from elsewhere may hold markers too.
    """
    status = (
        F.when(F.col("has_error"), "error")
        .when(F.col("has_results"), "done")
        .when(F.col("has_meta").isNotNull(), "in_progress")
        .otherwise("missing")
    )
    return jobs.join(_found(paths, failures), "job_id", "left").select("job_id", status.alias("status"))


def analysed_jobs(paths: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Jobs that left files and carry no error marker: one aggregate over the listing."""
    return _found(paths, failures).where(~F.col("has_error")).select("job_id")


def attach_meta(files: DataFrame, metas: DataFrame) -> DataFrame:
    """Join each file with the job record that lies in the same directory."""
    keyed = metas.withColumn("directory", directory_of(F.col("meta_path"))).drop("meta_path")
    return files.withColumn("directory", directory_of(F.col("path"))).join(keyed, "directory")
