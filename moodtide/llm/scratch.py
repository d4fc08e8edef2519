"""Intermediate tables in the folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from moodtide.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a file read, and what is read
    again is the same in every later job.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
