"""Aggregates over the subtree of each chosen node.

A subtree is the id range (node_id, node_id + descendant_count]. Its two ends
fall into leaf blocks of the file, where nodes are tested one by one against
the ranges that end in that same block. Everything between is whole blocks,
whose aggregates are computed once and joined by equality. A leaf block has at
most ``2**GRID.base`` nodes, so no task sees a whole file however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.predicates import is_branch, is_repeat, is_return
from canopy.plans.blocks import Grid

GRID = Grid(base=8, step=6, levels=4)

# What can be asked of a subtree: a number per node and how to fold it.
MEASURES = {
    "nodes": (lambda: F.lit(1).cast("bigint"), F.sum),
    "conditionals": (lambda: is_branch().cast("bigint"), F.sum),
    "loops": (lambda: is_repeat().cast("bigint"), F.sum),
    "return_count": (lambda: is_return().cast("bigint"), F.sum),
    "deepest": (lambda: F.col("depth"), F.max),
}


def subtree_measures(nodes: DataFrame, roots: DataFrame, measures: list[str], carry: list[str]) -> DataFrame:
    """One row per root: file_path, node_id, ``carry`` columns, and the measures.

    A root without descendants is kept, with 0 for sums and NULL for maxima.
    """
    points = nodes.select(
        "file_path",
        "node_id",
        F.expr(GRID.block_of("node_id")).alias("block"),
        *[F.coalesce(MEASURES[m][0](), F.lit(0)).alias(m) if MEASURES[m][1] is F.sum else MEASURES[m][0]().alias(m)
          for m in measures],
    )
    ident = ["file_path", "node_id", *[c for c in carry if c not in ("file_path", "node_id")]]
    ranges = (
        roots.where("descendant_count > 0")
        .select(*ident, (F.col("node_id") + 1).alias("first"), (F.col("node_id") + F.col("descendant_count")).alias("last"))
        .selectExpr("*", f"{GRID.block_of('first')} as first_block", f"{GRID.block_of('last')} as last_block")
    )
    found = _ends(points, ranges, ident, measures).unionByName(_middles(points, ranges, ident, measures))
    return _fold(found.unionByName(_nothing(roots, ident, measures, found)), ident, measures)


def _fold(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[MEASURES[m][1](m).alias(m) for m in measures])


def _nothing(roots: DataFrame, ident: list[str], measures: list[str], like: DataFrame) -> DataFrame:
    blank: list[Column] = [
        (F.lit(0) if MEASURES[m][1] is F.sum else F.lit(None)).cast(like.schema[m].dataType).alias(m) for m in measures
    ]
    return roots.select(*ident, *blank)


def _ends(points: DataFrame, ranges: DataFrame, ident: list[str], measures: list[str]) -> DataFrame:
    """Nodes in the first and last leaf block of each range."""
    both = F.when(F.col("first_block") == F.col("last_block"), F.array("first_block"))
    blocks = both.otherwise(F.array("first_block", "last_block"))
    at = ranges.select(*ident, "first", "last", F.explode(blocks).alias("block"))
    on = (
        (F.col("p.file_path") == F.col("r.file_path"))
        & (F.col("p.block") == F.col("r.block"))
        & F.col("p.node_id").between(F.col("r.first"), F.col("r.last"))
    )
    # No hint: adaptive execution hashes the ranges where all partitions of them are small, and sorts (and spills) else.
    return points.alias("p").join(at.alias("r"), on).select(*[f"r.{c}" for c in ident], *[f"p.{m}" for m in measures])


def _middles(points: DataFrame, ranges: DataFrame, ident: list[str], measures: list[str]) -> DataFrame:
    """Whole blocks strictly between the two ends of each range."""
    leaves = _fold(points, ["file_path", "block"], measures)
    blocks = _fold(
        leaves.withColumn("_at", F.explode(GRID.parents("block"))).select("file_path", "_at.level", "_at.block", *measures),
        ["file_path", "level", "block"],
        measures,
    )
    spans = ranges.where(F.col("last_block") - F.col("first_block") > 1)
    at = spans.select(*ident, F.explode(GRID.cover("first_block + 1", "last_block - 1")).alias("_at"))
    at = at.select(*ident, "_at.level", "_at.block")
    on = (
        (F.col("b.file_path") == F.col("r.file_path"))
        & (F.col("b.level") == F.col("r.level"))
        & (F.col("b.block") == F.col("r.block"))
    )
    return at.alias("r").join(blocks.alias("b"), on).select(*[f"r.{c}" for c in ident], *[f"b.{m}" for m in measures])
