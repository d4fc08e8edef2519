"""Content gate: whitelist characters, drop short words, keep texts with enough words left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from moodtide.functions.words import join_words, whitelist, words_longer_than

# Fixed values, needed for equal results.
BATCH_MIN_WORDS = 5
STREAM_MIN_WORDS = 6
SHORT_WORD = 2


def content_gate(df: DataFrame, text_col: str = "text", min_words: int = BATCH_MIN_WORDS) -> DataFrame:
    """Keep rows with at least `min_words` surviving words; the text becomes those words.

    The words are passed through a one-element array that is emptied when the
    row fails.  A plain filter on them would be pushed below the projection
    and the regexes would run twice for every row.
    """
    kept = words_longer_than(whitelist(F.col(text_col)), SHORT_WORD)
    passing = F.explode(F.filter(F.array(kept), lambda found: F.size(found) >= min_words))
    gated = df.select(*[passing.alias(name) if name == text_col else F.col(name) for name in df.columns])
    return gated.withColumn(text_col, join_words(F.col(text_col)))


def not_empty(df: DataFrame, text_col: str = "text_clean") -> DataFrame:
    """Rows whose text is still there after cleaning."""
    return df.where(F.col(text_col) != "")


def gate_counts(df: DataFrame, by: str, text_col: str = "text", min_words: int = BATCH_MIN_WORDS) -> DataFrame:
    """Rows before and after the gate per group, in one pass."""
    kept = F.size(words_longer_than(whitelist(F.col(text_col)), SHORT_WORD)) >= min_words
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("before_filtering"),
        F.count_if(kept).alias("after_filtering"),
    )


def observed_gate(
    df: DataFrame, text_col: str = "text", min_words: int = BATCH_MIN_WORDS
) -> tuple[DataFrame, Observation, Observation]:
    """The gate with its before/after counts as by-products of whatever job runs it."""
    before, after = Observation("before_filtering"), Observation("after_filtering")
    gated = content_gate(df.observe(before, F.count(F.lit(1)).alias("rows")), text_col, min_words)
    return gated.observe(after, F.count(F.lit(1)).alias("rows")), before, after
