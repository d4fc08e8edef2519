"""File sinks."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow.parquet import ParquetWriter
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodtide.operators.records import result_lines, to_json_lines
from moodtide.session import making_tasks, scratch_path
from moodtide.operators.registry import ERROR_FILE
from moodtide.sources.files import CSV_QUOTING, DEFAULT_MODEL_VERSION, model_path
from moodtide.sources.objects import opened, write_marker

# Writers trim values by default.
_CSV = {**CSV_QUOTING, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

Result = TypeVar("Result")


def keep(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write a frame to the scratch folder and read it back: computed once, and not again for a lost executor.

    Read by its own schema, or by one whose types are stored in the same way.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def write_tweets(tweets: DataFrame, path: str) -> None:
    tweets.write.options(**_CSV).csv(path, header=True)


def write_training(rows: DataFrame, path: str) -> None:
    rows.write.options(**_CSV).csv(path)


def write_clean(rows: DataFrame, path: str) -> None:
    """The cleaned data set, for later use."""
    rows.write.options(**_CSV).csv(path, header=True)


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a job in few files: AQE merges small jobs into one task and splits a hot one over many."""
    return rows.hint("rebalance", F.col("job_id"))


def write_results(
    predictions: DataFrame, path: str, by_job: bool = False, order_by: list[str] | None = None
) -> None:
    """`dt, prediction` lines, under one folder per job on request.

    With `order_by` the lines of a job keep that order over its files: rows are
    placed by ranges, so a hot job is written by many tasks, and files are
    numbered like the ranges.
    """
    rows = predictions
    if order_by:
        keys = ["job_id", *order_by] if by_job else order_by
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*order_by)
    elif by_job:
        rows = _gathered(rows)
    lines = result_lines(rows)
    writer = lines.write.partitionBy("job_id") if by_job else lines.select("value").write
    writer.text(path)


def store_by_job(rows: DataFrame, path: str, order_by: list[str]) -> None:
    """Rows of many jobs in few files, with an index that tells the files of each job.

    Rows are placed by ranges of job and order, so a file holds many small jobs
    or a piece of a hot one, and the number of files follows the bytes and not the
    jobs.  Column `place` numbers the rows in that order.
    """
    keys = ["job_id", *order_by]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    index = stored.groupBy("job_id", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # Sorted by job, so that a lookup reads few row groups.
    index.repartitionByRange("job_id").sortWithinPartitions("job_id").write.parquet(f"{path}/index")


def store_results(predictions: DataFrame, path: str, order_by: list[str]) -> None:
    """Results of many jobs by `store_by_job`; a missing time is spelled None."""
    moment = F.coalesce(F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    store_by_job(predictions.withColumn("dt", moment), path, order_by)


def export_results(results: DataFrame, path: str) -> None:
    """`dt, prediction` lines of the given jobs, in their order, under one folder per job.

    For the jobs that someone asked for; `store_results` holds all of them.
    """
    keys = ["job_id", "place"]
    placed = results.repartitionByRange(*keys).sortWithinPartitions(*keys)
    line = F.concat(F.col("dt"), F.lit(", "), F.col("prediction").cast("string"))
    placed.select("job_id", line.alias("value")).write.partitionBy("job_id").text(path)


def write_messages(rows: DataFrame, path: str) -> None:
    """One JSON message per row."""
    to_json_lines(rows).write.text(path)


def publish_messages(rows: DataFrame, servers: str, topic: str) -> None:
    """The same to a Kafka topic; needs the Kafka connector on the class path."""
    to_json_lines(rows).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def store_jobs(jobs: DataFrame, *folders: str) -> None:
    """Append job records to each of several places."""
    for folder in folders:
        jobs.write.mode("append").json(folder)


def stage_by_job(rows: DataFrame, path: str) -> None:
    """Copy rows into one folder per job, for few jobs; `store_by_job` takes any number."""
    _gathered(rows).write.mode("overwrite").partitionBy("job_id").parquet(path)


# What Spark writes for a missing folder name, and the characters that it escapes in others.
_NO_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


@contextmanager
def _whole(store: fs.FileSystem, folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A file that takes its name when it is whole; readers pass over the name it has until then."""
    unfinished = posixpath.join(folder, f".unfinished-{name}")
    try:
        # Other files may have made the folder; a call less for each of them.
        stream = store.open_output_stream(unfinished)
    except FileNotFoundError:
        store.create_dir(folder, recursive=True)
        stream = store.open_output_stream(unfinished)
    with stream:
        yield stream
    store.move(unfinished, posixpath.join(folder, name))


@contextmanager
def _written(stream: pa.NativeFile, kind: str, schema: pa.Schema) -> Iterator[Callable[[pa.RecordBatch], None]]:
    """Takes rows of one file, in parts: columns for `parquet`, a column of lines for `json`."""
    if kind == "parquet":
        with ParquetWriter(stream, schema) as writer:
            yield writer.write_batch
    else:
        yield lambda rows: stream.write("".join(f"{line}\n" for line in rows.column(0).to_pylist()).encode())


def _folder_files(path: str, kind: str, folder_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writer of one task, for rows sorted by folder (the first column): a file per folder.

    A file has the same name whenever its task is repeated, so no row is written twice.
    """
    written = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{written}.{kind}"
        files, now, put = 0, None, None
        with ExitStack() as held:
            for batch in batches:
                runs, rows = pc.run_end_encode(batch.column(0)), batch.drop_columns(batch.schema.names[0])
                start = 0
                for folder, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if put is None or folder != now:
                        held.close()
                        value = _NO_FOLDER if folder is None else _ESCAPED.sub(lambda found: f"%{ord(found[0]):02X}", folder)
                        stream = held.enter_context(_whole(store, posixpath.join(base, f"{folder_col}={value}"), name))
                        put, now, files = held.enter_context(_written(stream, kind, rows.schema)), folder, files + 1
                    put(rows.slice(start, end - start))
                    start = end
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_folders(rows: DataFrame, path: str, kind: str, folder_col: str = "folder") -> int:
    """Append one file of a kind (`parquet`, `json`) to the folder that each row names, for very many small folders.

    The folders are those of `partitionBy`.  The tasks write through Arrow's file system, as Spark's writers take
    several calls, and on local disks processes, for each file and folder.  A write that fails may leave
    some of its files: for folders that are read when it is done.  Returns the number of files.
    """
    if kind not in ("parquet", "json"):
        raise ValueError(f"unknown kind of file: {kind}")
    others = [F.col(f"`{name}`") for name in rows.columns if name != folder_col]
    values = others if kind == "parquet" else [F.to_json(F.struct(*others)).alias("line")]
    named = rows.select(F.nullif(F.col(folder_col).cast("string"), F.lit("")).alias(folder_col), *values)
    dealt = named.repartition(making_tasks(rows.sparkSession), folder_col).sortWithinPartitions(folder_col)
    files = dealt.mapInArrow(_folder_files(path, kind, folder_col), "files long")
    return files.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def save_model(model: PipelineModel, root: str, version: str = DEFAULT_MODEL_VERSION) -> str:
    path = model_path(root, version)
    model.write().overwrite().save(path)
    return path


def save_held_out(predicted: DataFrame, root: str, version: str = DEFAULT_MODEL_VERSION) -> DataFrame:
    """Held-out predictions next to the model, and the table read back."""
    path = f"{root}/models/{version}/held_out"
    predicted.write.mode("overwrite").parquet(path)
    return predicted.sparkSession.read.schema(predicted.schema).parquet(path)


def save_scores(scores: DataFrame, root: str, version: str = DEFAULT_MODEL_VERSION) -> str:
    """Evaluation figures next to the model, as JSON."""
    path = f"{root}/models/{version}/scores"
    scores.write.mode("overwrite").json(path)
    return path


def save_report(report: DataFrame, root: str, version: str = DEFAULT_MODEL_VERSION) -> str:
    """The class report next to the model, as JSON."""
    path = f"{root}/models/{version}/report"
    report.write.mode("overwrite").json(path)
    return path


def store_failures(failures: DataFrame, path: str) -> None:
    """Append error markers (`job_id`, `message`) to the table that `sources.files.failures` reads."""
    failures.select("job_id", "message").write.mode("append").json(path)


def recording_failure(
    spark: SparkSession, job_id: str, errors_path: str, work: Callable[[], Result]
) -> Result:
    """Run the work of a job; if it fails, append an error marker and fail all the same."""
    try:
        return work()
    except Exception as error:
        marker = spark.createDataFrame([(job_id, str(error))], "job_id string, message string")
        store_failures(marker, errors_path)
        raise


def marking_failure(root: str, job_id: str, work: Callable[[], Result]) -> Result:
    """Run the work of a job; if it fails, leave an error marker in the job's folder and fail all the same."""
    try:
        return work()
    except Exception as error:
        write_marker(root, f"jobs/{job_id}/{ERROR_FILE}", str(error))
        raise
