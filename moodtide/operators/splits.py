"""Training/test splits and label codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, needed for equal results.
TRAIN_SHARE = 0.8
SEED = 100500
LABEL_CODES = {0: 0, 4: 1}


def random_split(df: DataFrame, train_share: float = TRAIN_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Row-wise random split.  It depends on the partitioning of the input."""
    train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


def split_label(id_col: Column, train_share: float = TRAIN_SHARE, seed: int = SEED) -> Column:
    """`train` or `test`, a function of the row id alone.

    The first eight hex digits of a hash are compared as text, which orders
    them like the numbers they spell.  The split survives repartitioning and
    lost executors, and other engines can repeat it.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
    threshold = format(int(train_share * (1 << 32)), "08x")
    return F.when(F.substring(digest, 1, 8) < threshold, "train").otherwise("test")


def stable_split(
    df: DataFrame, id_col: str, train_share: float = TRAIN_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    part = split_label(F.col(id_col), train_share, seed)
    return df.where(part == "train"), df.where(part == "test")


def recode_label(label: Column, codes: dict[int, int] | None = None) -> Column:
    """Look a label up in a small code table; unknown labels become null."""
    table = F.create_map(*[F.lit(part) for pair in (codes or LABEL_CODES).items() for part in pair])
    return F.try_element_at(table, label.cast("int"))
