"""What changed between two snapshots of a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.operators.lookup import Globs, scan_nodes
from canopy.operators.metrics import function_metrics
from canopy.plans.copies import copies_in_order
from canopy.plans.suffixes import match_suffix


def _top_definitions(nodes: DataFrame) -> DataFrame:
    return nodes.where(P.is_definition() & P.is_top_level() & P.is_named())


def structural_diff(old: DataFrame, new: DataFrame, file: Globs = "**") -> DataFrame:
    """Definitions added, removed or changed in shape, per file.

    Matching is by (file, name, kind). Where a name repeats, every old one is
    compared with every new one. Equal definitions are counted before the
    join, and pairs without a change are dropped before the counts are
    written out, so copies cost nothing.
    """

    def shapes(nodes: DataFrame, side: str) -> DataFrame:
        return (
            _top_definitions(scan_nodes(nodes, file))
            .groupBy(
                "file_path", "name", F.col("semantic_type").alias("kind"),
                (F.col("end_line") - F.col("start_line") + 1).alias(f"{side}_lines"),
                F.col("descendant_count").alias(f"{side}_complexity"),
                F.col("children_count").alias(f"{side}_children"),
            )
            .agg(F.count("*").alias(f"{side}_copies"))
        )

    pairs = shapes(new, "new").join(shapes(old, "old"), ["file_path", "name", "kind"], "full_outer")
    change = (
        F.when(F.col("old_copies").isNull(), "added")
        .when(F.col("new_copies").isNull(), "removed")
        .when(
            (F.col("new_complexity") != F.col("old_complexity")) | (F.col("new_children") != F.col("old_children")), "modified"
        )
        .otherwise("unchanged")
    )
    changed = pairs.withColumn("change", change).where("change <> 'unchanged'")
    delta = F.coalesce("new_complexity", F.lit(0)) - F.coalesce("old_complexity", F.lit(0))
    rows = changed.select(
        "file_path", "name", "kind", "change", "old_lines", "new_lines", "old_complexity", "new_complexity",
        delta.alias("complexity_delta"),
        (F.coalesce("old_copies", F.lit(1)) * F.coalesce("new_copies", F.lit(1))).alias("pairs"),
    )
    return copies_in_order(rows, "pairs", ["file_path", "change", "name", "old_complexity", "new_complexity"])


def changed_function_summary(nodes: DataFrame, changes: DataFrame, file_pattern: Globs) -> DataFrame:
    """Definitions in added or modified files, most complex first.

    ``changes`` (file_path, status) may name files by a shorter path than the
    node table does. Paths are matched once per file, not per definition, and only the matched files are measured.
    """
    tree = scan_nodes(nodes, file_pattern)
    wanted = changes.where(F.col("status").isin("added", "modified")).select(
        F.col("file_path").alias("changed_path"), F.col("status").alias("change_status")
    )
    files = match_suffix(tree, wanted).select("file_path", "change_status")
    tree = tree.join(files.select("file_path").distinct(), "file_path", "left_semi")
    defs = _top_definitions(tree).select(
        "file_path", "name", F.col("semantic_type").alias("kind"), "start_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"),
    )
    metrics = function_metrics(tree).select("file_path", "name", "cyclomatic")
    joined = defs.join(files, "file_path").join(metrics, ["file_path", "name"], "left")
    ranked = joined.withColumn("cyclomatic", F.coalesce("cyclomatic", F.lit(0)))
    return ranked.orderBy(F.desc("cyclomatic"), "file_path", "start_line", "name", "lines").select(
        "file_path", "name", "kind", "lines", "cyclomatic", "change_status"
    )
