"""Which scope encloses a line, and who calls a function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.operators.lookup import Globs, scan_nodes
from canopy.plans.enclosing import innermost


def _resolved(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    named = nodes.where(F.col("semantic_type").isin(P.FUNCTION, P.CLASS, P.MODULE) & P.is_named())
    scopes = named.select(
        "file_path", F.col("start_line").alias("def_start"), F.col("end_line").alias("def_end"),
        "node_id", "name", F.col("semantic_type").alias("kind"),
    )
    points = calls.select("file_path", F.col("start_line").alias("call_line"))
    best = innermost(points, scopes, ["file_path"], "call_line", "def_start", "def_end")
    # Scopes on the very same lines: the later node, which is the inner one.
    owner = scopes.groupBy("file_path", "def_start", "def_end").agg(F.max(F.struct("node_id", "name", "kind")).alias("scope"))
    return best.join(owner, ["file_path", "def_start", "def_end"], "left").select(
        "file_path", "call_line", F.col("scope.name").alias("caller_name"), F.col("scope.kind").alias("caller_kind")
    )


def enclosing_scopes(nodes: DataFrame) -> DataFrame:
    """Every line that holds a call, with its smallest named function, class or module."""
    return _resolved(nodes, nodes.where(P.is_call()))


def function_callers(nodes: DataFrame, file_pattern: Globs, func_name: str) -> DataFrame:
    """Call lines of an exact name with their enclosing scope; unenclosed calls keep a NULL caller.

    Several calls on one line are one row.
    """
    tree = scan_nodes(nodes, file_pattern)
    calls = tree.where(P.is_call() & (F.col("name") == func_name))
    # Only the scopes of files that hold such a call can enclose one.
    called = tree.join(calls.select("file_path").distinct(), "file_path", "left_semi")
    return _resolved(called, calls).orderBy("file_path", "call_line")
