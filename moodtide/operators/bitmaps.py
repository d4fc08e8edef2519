"""Sets of terms as bitmaps of a fixed size, for tests inside a row.

A term that is in the set always passes; one that is not may pass by a clash.
The size does not grow with the set, so the bitmap can go to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A quarter of a megabyte.
BITS = 1 << 21


def _place(term: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(bits))


def bitmap(terms: DataFrame, term_col: str, bits: int = BITS) -> Column:
    """The bitmap of a column of terms, as a constant.

    Built by an aggregate over the terms; what comes to the driver are its `bits` / 64 words at most.
    """
    place = terms.select(_place(F.col(term_col), bits).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word")
    )
    held = dict(zip(*(column.to_pylist() for column in words.toArrow().columns)))
    # As text, which becomes one array when the plan is optimized; a list would be a column per word.
    listed = ",".join(str(held.get(at, 0)) for at in range(bits // 64))
    return F.split(F.lit(listed), ",").cast("array<bigint>")


def may_hold(words: Column, term: Column, bits: int = BITS) -> Column:
    """Whether a term may be in the set of a bitmap; never false for one that is."""
    place = _place(term, bits)
    return F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
