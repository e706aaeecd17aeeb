"""The node table: schema, the one safe way to join it, and its input contract.

One row per tree node. ``node_id`` is a dense pre-order number inside one
``file_path``, so a node's subtree is the contiguous id range
``(node_id, node_id + descendant_count]`` of the same file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])

NODE_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("node_id", T.LongType(), False),
        T.StructField("parent_id", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("semantic_type", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("descendant_count", T.LongType()),
        T.StructField("children_count", T.LongType()),
        T.StructField("peek", T.StringType()),
        T.StructField("parameters", T.ArrayType(PARAMETER)),
        T.StructField("signature_type", T.StringType()),
    ]
)


def same_file(left: str, right: str, on: Column | None = None) -> Column:
    """Join condition between two aliased node relations.

    ``node_id`` means nothing outside its file, so the file equality is always
    part of the condition and cannot be left out by a caller.
    """
    files = F.col(f"{left}.file_path") == F.col(f"{right}.file_path")
    return files if on is None else files & on


def child_of(child: str, parent: str, parent_key: str = "node_id") -> Column:
    """``child`` is a direct child of ``parent`` (both aliases), in one file."""
    return same_file(child, parent, F.col(f"{child}.parent_id") == F.col(f"{parent}.{parent_key}"))


def require_nodes(nodes: DataFrame) -> DataFrame:
    """Fail on an empty node table, whose empty answers would read as 'no drift'."""
    if nodes.limit(1).count() == 0:
        raise ValueError("the node table is empty: rebuild it before asking about drift or missing symbols")
    return nodes


def clustered(nodes: DataFrame) -> DataFrame:
    """Sorted by file and node inside each part, so that a path filter can skip row groups.

    Parts are hashed by file and id block: a huge file is spread, and unlike a
    range exchange nothing is computed twice for a sample.
    """
    spread = nodes.repartition("file_path", F.shiftright("node_id", 16))
    return spread.sortWithinPartitions("file_path", "node_id")
