"""Evaluate an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `use`, which may refer to it many times.

    A plain reference would be replaced by the expression behind it wherever
    the optimizer merges projections or pushes a filter; inside a lambda that
    repeats the expression for every element.
    """
    return F.get(F.transform(F.array(value), use), 0)
