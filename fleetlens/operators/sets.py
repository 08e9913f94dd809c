"""Unions of what several databases of a server deliver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def append_databases(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several databases or layouts as one table; columns that a part lacks are missing values."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
