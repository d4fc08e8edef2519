"""From raw documents to packed sequences, in stages that are each written and read again.

Stages, in order: documents that fail a quality rule go; of each group of near
copies one stays; documents contaminated by the benchmark go; secrets are replaced in the texts;
what is left is packed into sequences of token ids.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodtide.llm.decontaminate import decontaminate
from moodtide.llm.minslack import pack
from moodtide.llm.quality import quality_filter
from moodtide.llm.scratch import stored
from moodtide.llm.secrets import redact
from moodtide.llm.simhash import keep_first
from moodtide.llm.tokens import tokenizer_path
from moodtide.sources.files import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule."""
    return quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and their lengths set anew."""
    return redact(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

# Fingerprints and token ids have no SQL counterpart; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, f"stage-{number}")
    return docs
