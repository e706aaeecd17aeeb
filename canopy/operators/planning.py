"""Pinned symbols: capture them, and later ask which have moved or vanished."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import predicates as P
from canopy.functions.patterns import ilike, path_matches
from canopy.nodes import require_nodes
from canopy.plans.copies import copies_in_order

PLANNING_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("symbol_kind", T.StringType(), False),
        T.StructField("symbol_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("captured_at", T.TimestampType()),
    ]
)


def capture_planning_context(
    nodes: DataFrame, task_id: str, role: str, pattern: str | Iterable[str], name_like: str, captured_at: Column | None = None
) -> DataFrame:
    """Pin the functions and classes whose name is ILIKE the pattern, outside test files."""
    wanted = F.col("semantic_type").isin(P.FUNCTION, P.CLASS) & ilike(F.col("name"), name_like)
    kind = F.when(P.is_function_definition(), "function").when(P.is_class_definition(), "type").otherwise("file")
    return nodes.where(path_matches(pattern) & wanted & ~P.is_test_file()).select(
        F.lit(task_id).alias("task_id"), F.lit(role).alias("role"), kind.alias("symbol_kind"),
        F.col("name").alias("symbol_name"), "file_path",
        F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"),
        F.col("peek").alias("signature"),
        (F.current_timestamp() if captured_at is None else captured_at).alias("captured_at"),
    )


def _pinned_nodes(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """The nodes that share name and file with some pin; the few pins may be sent to the nodes."""
    wanted = pins.select("symbol_name", "file_path").distinct()
    named = nodes.select(F.col("name").alias("symbol_name"), "file_path", "start_line")
    return named.join(wanted, ["symbol_name", "file_path"], "left_semi")


def planning_drift(planned: DataFrame, nodes: DataFrame, task_id: str) -> DataFrame:
    """Pinned symbols with a node of the same name and file on another line.

    Every node of the name counts, calls included. Only nodes that some pin names are folded to (name, file, line)
    with a count, which the join then carries.
    """
    pins = planned.where((F.col("task_id") == task_id) & F.col("line_start").isNotNull()).select(
        "task_id", "symbol_name", "file_path", F.col("line_start").alias("planned_line"), "captured_at"
    )
    lines = (
        _pinned_nodes(require_nodes(nodes), pins)
        .groupBy("symbol_name", "file_path", F.col("start_line").alias("current_line"))
        .agg(F.count("*").alias("times"))
    )
    moved = pins.join(lines, ["symbol_name", "file_path"]).where("current_line <> planned_line")
    drift = F.abs(F.col("current_line") - F.col("planned_line")).alias("drift_lines")
    rows = moved.select("task_id", "symbol_name", "file_path", "planned_line", "current_line", "captured_at", drift, "times")
    return copies_in_order(rows, "times", [F.desc("drift_lines"), "file_path", "symbol_name", "current_line"])


def missing_symbols(planned: DataFrame, nodes: DataFrame, task_id: str) -> DataFrame:
    """Pinned symbols that no node of the same name and file exists for any more."""
    pins = planned.where(F.col("task_id") == task_id)
    present = _pinned_nodes(require_nodes(nodes), pins).select("symbol_name", "file_path").distinct()
    return pins.join(present, ["symbol_name", "file_path"], "left_anti").select("symbol_name", "file_path", "role")


def orientation(planned: DataFrame, task_id: str) -> DataFrame:
    """The symbols a task is to modify or implement."""
    wanted = planned.where((F.col("task_id") == task_id) & F.col("role").isin("modify", "implement"))
    return wanted.select(
        "task_id", "role", "symbol_kind", "symbol_name", "file_path", "line_start", "line_end"
    ).orderBy("role", "file_path", F.col("line_start").asc_nulls_last())


def capture_quality(planned: DataFrame, task_id: str) -> DataFrame:
    """How many symbols a task has pinned, and how many of them lack a signature."""
    blank = F.col("signature").isNull() | (F.trim("signature") == "")
    return planned.where(F.col("task_id") == task_id).agg(
        F.count("*").alias("captured"), F.count_if(blank).alias("missing_signature")
    )
