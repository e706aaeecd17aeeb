"""The registered queries: each operator run on the given tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Runner] = field(default_factory=dict)
    oracle: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, run: Runner, sql: str | None = None) -> None:
        self.queries[name] = run
        if sql is not None:
            self.oracle[name] = sql


def load() -> Catalog:
    from canopy.catalog import review, structure, text

    catalog = Catalog()
    for part in (structure, text, review):
        part.register(catalog)
    return catalog
