"""Import edges between modules, with fan-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.functions.patterns import like
from canopy.operators.lookup import Globs, scan_nodes
from canopy.plans.copies import copies_in_order


def _edges_with_fan_in(imports: DataFrame, target: Column, source: Column) -> DataFrame:
    raw = imports.select("file_path", target.alias("target_module")).where("target_module <> ''").distinct()
    edges = raw.select(source.alias("source_module"), "target_module").where("source_module <> ''")
    # Equal edges of different files are counted, not multiplied through the join.
    counted = edges.groupBy("source_module", "target_module").agg(F.count("*").alias("copies"))
    fan_in = counted.groupBy("target_module").agg(F.sum("copies").alias("fan_in"))
    joined = counted.join(fan_in, "target_module").select("source_module", "target_module", "fan_in", "copies")
    return copies_in_order(joined, "copies", ["source_module", "target_module"])


def module_dependencies(nodes: DataFrame, file_pattern: Globs, package_prefix: str) -> DataFrame:
    """``from <prefix>... import`` edges between modules named after their ``.py`` path.

    The prefix is used as it is in LIKE and in the patterns. A package's
    ``__init__`` file becomes the package name with a dot at its end.
    """
    imports = scan_nodes(nodes, file_pattern).where(P.is_import() & like(F.col("peek"), f"%from {package_prefix}%"))
    target = F.regexp_extract("peek", f"from ({package_prefix}[a-zA-Z0-9_.]*)", 1)
    path = F.regexp_extract("file_path", rf"((?:{package_prefix})[a-zA-Z0-9_./]*)\.py$", 1)
    source = F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit("__init__"), F.lit(""))
    return _edges_with_fan_in(imports, target, source)


def link_dependencies(nodes: DataFrame, file_pattern: Globs = "**") -> DataFrame:
    """The same question for markup: host of the page -> site path it links to."""
    imports = scan_nodes(nodes, file_pattern).where(P.is_import())
    return _edges_with_fan_in(
        imports, F.regexp_extract("peek", r'href="(/[^"]*)"', 1), F.regexp_extract("file_path", r"^https?://([^/]+)", 1)
    )
