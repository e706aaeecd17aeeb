"""Size and complexity of definitions, from subtree aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.operators.lookup import Globs, scan_nodes
from canopy.plans.subtrees import subtree_measures


def code_structure(nodes: DataFrame, file_pattern: Globs) -> DataFrame:
    """Named definitions at depth <= 2 with size; functions also with cyclomatic complexity.

    A function without descendants has no complexity here (NULL).
    """
    tree = scan_nodes(nodes, file_pattern)
    defs = tree.where(P.is_definition() & P.is_named() & P.is_top_level())
    shape = ["name", "semantic_type", "start_line", "end_line", "descendant_count", "children_count"]
    functions = subtree_measures(
        tree, defs.where(P.is_function_definition()), ["nodes", "conditionals", "loops"], shape
    ).withColumn("cyclomatic_complexity", F.when(F.col("nodes") > 0, F.col("conditionals") + F.col("loops") + 1))
    others = defs.where(~P.is_function_definition()).withColumn("cyclomatic_complexity", F.lit(None).cast("bigint"))
    keep = ["file_path", "node_id", *shape, "cyclomatic_complexity"]
    rows = functions.select(*keep).unionByName(others.select(*keep)).orderBy("file_path", "start_line", "node_id")
    return rows.select(
        "file_path", "name", F.col("semantic_type").alias("kind"), "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("line_count"),
        "descendant_count", "children_count", "cyclomatic_complexity",
    )


def function_metrics(nodes: DataFrame) -> DataFrame:
    """Lines, complexity, returns and nesting depth of every named function.

    A function without descendants counts as complexity 1, depth 0.
    """
    functions = nodes.where(P.is_function_definition() & P.is_named())
    measured = subtree_measures(
        nodes, functions, ["conditionals", "loops", "return_count", "deepest"], ["name", "start_line", "end_line", "depth"]
    )
    return measured.select(
        "file_path", "node_id", "name", "start_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"),
        (F.col("conditionals") + F.col("loops") + 1).alias("cyclomatic"),
        "conditionals", "loops", "return_count",
        F.coalesce(F.col("deepest") - F.col("depth"), F.lit(0)).alias("max_depth"),
    )


def complexity_hotspots(nodes: DataFrame, file_pattern: Globs, n: int = 20) -> DataFrame:
    """The n most complex functions; equal ones in order of file and position."""
    return hotspots_of(function_metrics(scan_nodes(nodes, file_pattern)), n)


def hotspots_of(measured: DataFrame, n: int = 20) -> DataFrame:
    """The n most complex of measured functions."""
    ranked = measured.orderBy(F.desc("cyclomatic"), "file_path", "node_id").limit(n)
    return ranked.select("file_path", "name", "lines", "cyclomatic", "conditionals", "loops", "return_count", "max_depth")


def subtree_summary(nodes: DataFrame) -> DataFrame:
    """Branch counts and depth below every named definition of any kind, whole files included."""
    roots = nodes.where(P.is_definition() & P.is_named())
    measured = subtree_measures(nodes, roots, ["nodes", "conditionals", "loops", "return_count", "deepest"], ["depth"])
    return measured.select(
        "file_path", "node_id", "nodes", "conditionals", "loops", "return_count",
        F.coalesce(F.col("deepest") - F.col("depth"), F.lit(0)).alias("max_depth"),
    )


def branch_counts(nodes: DataFrame) -> DataFrame:
    """Branches, loops and returns per file."""
    return nodes.groupBy("file_path").agg(
        F.count_if(P.is_branch()).alias("conditionals"),
        F.count_if(P.is_repeat()).alias("loops"),
        F.count_if(P.is_return()).alias("return_count"),
    )
