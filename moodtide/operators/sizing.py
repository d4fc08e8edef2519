"""Size checks made before a table is broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast table is held whole by the driver and by every executor.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Size:
    rows: int
    text_bytes: int
    extra: dict = field(default_factory=dict, compare=False)

    def fits_broadcast(self, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
        return self.rows <= max_rows and self.text_bytes + 16 * self.rows <= max_bytes


def measure(df: DataFrame, **extra: Column) -> Size:
    """Rows and text bytes of a table, by one aggregate over it; `extra` aggregates ride along."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    total = sum((F.coalesce(F.octet_length(F.col(name)), F.lit(0)) for name in texts), F.lit(0))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(total.cast("bigint")).alias("text_bytes"),
        *[column.alias(name) for name, column in extra.items()],
    ).first()
    return Size(row["rows"], row["text_bytes"] or 0, {name: row[name] for name in extra})


def broadcast_if_small(df: DataFrame, size: Size | None = None) -> DataFrame:
    """Hint a broadcast only for a table measured to be small.

    Otherwise the join is left to the optimizer, which shuffles both sides
    and lets AQE split skewed partitions.
    """
    size = size or measure(df)
    return F.broadcast(df) if size.fits_broadcast() else df
