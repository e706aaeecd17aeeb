"""Scan-and-filter questions over a node table: where is it, what is it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.functions.patterns import ilike, like, path_matches

Globs = str | Iterable[str]


def scan_nodes(nodes: DataFrame, file_pattern: Globs) -> DataFrame:
    """Nodes of the files that match a glob, or any of several globs."""
    return nodes.where(path_matches(file_pattern))


def with_peek(nodes: DataFrame, length: int | str = 200) -> DataFrame:
    """Cut ``peek`` to a length, or leave it whole with ``'full'``."""
    return nodes if length == "full" else nodes.withColumn("peek", F.left(F.col("peek"), F.lit(int(length))))


def _in_order(found: DataFrame, *columns: Column | str) -> DataFrame:
    """Chosen columns in reading order; the node number settles ties and lets a crowded line be split."""
    order = ["file_path", F.col("start_line").asc_nulls_last(), "node_id"]
    return found.select(*columns, "node_id").orderBy(*order).drop("node_id")


def find_definitions(nodes: DataFrame, file_pattern: Globs, name_pattern: str = "%") -> DataFrame:
    """Named definitions: top-level functions, classes and modules, or any by name pattern."""
    found = scan_nodes(nodes, file_pattern).where(P.is_named())
    if name_pattern == "%":
        code = F.col("semantic_type").isin(P.FUNCTION, P.CLASS, P.MODULE)
        found = found.where(code & P.is_top_level())
    else:
        found = found.where(P.is_definition() & like(F.col("name"), name_pattern))
    kind, signature = F.col("semantic_type").alias("kind"), F.col("peek").alias("signature")
    return _in_order(found, "file_path", "name", kind, "start_line", "end_line", signature)


def find_calls(nodes: DataFrame, file_pattern: Globs, name_pattern: str = "%") -> DataFrame:
    found = scan_nodes(nodes, file_pattern).where(P.is_call() & like(F.col("name"), name_pattern))
    return _in_order(found, "file_path", "name", "start_line", F.col("peek").alias("call_expression"))


def find_imports(nodes: DataFrame, file_pattern: Globs) -> DataFrame:
    """Imports, unnamed ones included."""
    found = scan_nodes(nodes, file_pattern).where(P.is_import())
    return _in_order(found, "file_path", "name", F.col("peek").alias("import_statement"), "start_line")


def find_in_tree(nodes: DataFrame, file_pattern: Globs, kind: str, name_pattern: str = "%") -> DataFrame:
    """Nodes of one kind by name; an unknown kind finds nothing."""
    found = scan_nodes(nodes, file_pattern).where(P.of_kind(kind) & like(F.col("name"), name_pattern))
    return _in_order(found, "file_path", "name", "start_line", F.col("peek").alias("context"))


# The kinds a symbol search asks for.
SYMBOL_KINDS = ("function", "type", "interface", "class", "method")


def symbols(nodes: DataFrame) -> DataFrame:
    """Definitions under short kind names, with ``line`` for the first line."""
    kind = (
        F.when(F.col("type") == "method_declaration", "method")
        .when(P.is_function_definition(), "function")
        .when(P.is_class_definition(), "class")
        .when(F.col("type") == "interface_type", "interface")
        .when(F.col("semantic_type") == P.TYPE, "type")
        .when(P.is_module_definition(), "module")
    )
    return nodes.select("name", kind.alias("kind"), "file_path", F.col("start_line").alias("line"))


def search_symbols(nodes: DataFrame, symbol: str, limit: int = 30) -> DataFrame:
    """The first symbols whose name contains a text, in any case."""
    found = symbols(nodes).where(ilike(F.col("name"), f"%{symbol}%") & F.col("kind").isin(*SYMBOL_KINDS))
    return found.orderBy("file_path", "line", "name", "kind").limit(limit)


def table_stats(nodes: DataFrame) -> DataFrame:
    """Node count and file count; a node count of 0 means nothing was scanned."""
    per_file = nodes.groupBy("file_path").agg(F.count("*").alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.count("file_path").alias("file_count"))
