"""File sources."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.timestamps import parse_timestamp
from moodtide.schemas import JOB_META, RESULTS, TRAINING, TWEETS

# Fixed value: the model version used when none is named.
DEFAULT_MODEL_VERSION = "v5"

# Spark's own bound for a split of a file.
SPLIT_BYTES = 128 << 20

# CSV writers double a quote inside a quoted field; Spark expects a backslash by default.
CSV_QUOTING = {"quote": '"', "escape": '"'}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """Use more tasks for a table of few file splits, whose texts are costly to process.

    A split is at least 4 MB, so no task gets less than about 1 MB.  A table
    with as many splits as there are cores is left alone: no shuffle.
    """
    splits = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if splits >= cores else df.repartition(min(cores, splits * factor))


def fewer_splits(df: DataFrame, most: int = SPLIT_BYTES) -> DataFrame:
    """Stored rows in as few tasks as cores, or as many as give each `most` bytes on average; for what is passed many times.

    A session may ask for small splits, and then the tasks, and what each sends the driver, grow with the rows.
    """
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    held = files.agg(F.sum("file_size").alias("held")).first()["held"] or 0
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-held // most)))


def tweets_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Collected tweets with a header.

    Gated texts hold no line breaks, so files stay splittable; `multi_line`
    is for files from elsewhere.
    """
    return spark.read.schema(TWEETS).options(**CSV_QUOTING).csv(path, header=True, multiLine=multi_line)


def typed_tweets(raw: DataFrame) -> DataFrame:
    """Counts, text and a parsed time; rows without a text are dropped first."""
    return raw.where(F.col("tweet").isNotNull()).select(
        "replies_count",
        "retweets_count",
        "likes_count",
        F.col("tweet").alias("text"),
        parse_timestamp(F.col("datetime")).alias("dt"),
    )


def training_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Labelled rows, six columns without a header."""
    return spark.read.schema(TRAINING).options(**CSV_QUOTING).csv(path, multiLine=multi_line)


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose types are unknown: read twice, for a first look only."""
    return spark.read.options(**CSV_QUOTING).csv(path, header=True, inferSchema=True)


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _folders_per_task(spark: SparkSession) -> Iterator[None]:
    """Folders are listed when a reader is made, each in a task of its own, which takes longer to start than to run; here in few tasks."""
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def job_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Job records from every *.json below a folder, with the path of their file.

    Records take one line each; `multi_line` reads files that hold a single
    record over several lines.
    """
    reader = spark.read.schema(JOB_META).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    with _folders_per_task(spark):
        records = reader.option("multiLine", multi_line).json(path)
    return records.select("*", F.col("_metadata.file_path").alias("meta_path"))


def object_listing(spark: SparkSession, path: str, name_filter: str | None = None) -> DataFrame:
    """Names, times and sizes of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    with _folders_per_task(spark):
        return reader.load(path).select("path", "modificationTime", "length")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Error markers of failed jobs, as `sinks.files.store_failures` leaves them."""
    return spark.read.schema("job_id string, message string").json(path)


def relative_paths(listing: DataFrame, anchor: str = "jobs/") -> DataFrame:
    """Paths from the last `anchor` folder on, as object stores name them."""
    start = F.regexp_extract(F.col("path"), f"^(?:.*/)?({anchor}.*)$", 1)
    return listing.withColumn("path", start).where(F.col("path") != "")


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions with their place in the file as `seq`.

    Result files may be split over tasks, so the order is kept as number of
    the part, file, split offset and row number within the split.
    """
    place = F.struct(
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("bigint").alias("part"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return (
        spark.read.schema(RESULTS)
        .option("ignoreLeadingWhiteSpace", True)
        .csv(path)
        .select("*", place.alias("seq"))
    )


# Up to so many jobs are looked up in the index; for more, the rows are joined with the jobs.
INDEXED_JOBS = 10_000


def rows_by_job(spark: SparkSession, path: str, jobs: DataFrame | None = None) -> DataFrame:
    """Rows of `sinks.files.store_by_job`: all, or those of some jobs (column `job_id`).

    For some jobs only the files that the index names are opened, and in these the
    row groups whose range of jobs fits.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if jobs is None:
        return rows
    wanted = jobs.select("job_id").distinct()
    few = [row["job_id"] for row in wanted.limit(INDEXED_JOBS + 1).collect()]
    if len(few) > INDEXED_JOBS:
        return rows.join(wanted, "job_id", "left_semi")
    index = spark.read.parquet(f"{path}/index").where(F.col("job_id").isin(few))
    files = sorted(row["file"] for row in index.select("file").distinct().collect())
    named = spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{file}" for file in files]) if files else rows.limit(0)
    return named.where(F.col("job_id").isin(few))


def model_path(root: str, version: str = DEFAULT_MODEL_VERSION) -> str:
    return f"{root}/models/{version}/pipeline"


def load_model(root: str, version: str = DEFAULT_MODEL_VERSION) -> PipelineModel:
    return PipelineModel.load(model_path(root, version))
