"""Join paths with the shorter paths they end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_suffixes(path: Column) -> Column:
    """The path itself and what follows each ``/`` of it."""
    parts = F.split(path, "/")
    count = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, count - i + 1), "/")
    )


def match_suffix(paths: DataFrame, suffixes: DataFrame, path: str = "file_path", suffix: str = "changed_path") -> DataFrame:
    """Rows of distinct ``path`` values joined with every ``suffix`` row they end with at a ``/``.

    Equal to ``path = suffix OR path ends with '/' + suffix``, as an equi-join.
    """
    each = paths.select(path).distinct().select(path, F.explode(F.array_distinct(path_suffixes(F.col(path)))).alias(suffix))
    return each.join(suffixes, suffix)
