"""Joins whose keys may be NULL: a NULL key is a group of its own."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on `keys` that lets NULL meet NULL; the result has the left
    side's columns and the right side's other ones."""
    marks = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(marks)
    on = [F.col(k).eqNullSafe(F.col(m)) for k, m in marks.items()]
    return left.join(right, on, how).drop(*marks.values())
