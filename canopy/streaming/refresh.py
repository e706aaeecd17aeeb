"""Incremental refresh of a node table as a stream of re-read files.

Tables are kept in merged parts: ``index`` has, per file, its newest version that has arrived whole; ``nodes`` the rows
of such versions; ``open`` the rows of versions that are not whole yet, and ``tally`` their number. A batch compares its files
with the index, drops what is older or was there before, and adds up the tally of its versions. Only where that says that a
version may be whole are its open rows read, to tell for certain and to move it to ``nodes``; so a file that arrives over many
batches is read once, not in each of them. Node rows of other files are not read. A read takes the node rows that the index names.

What depends on the nodes of one file alone is kept in the same way: ``metrics`` has the measures of every function,
computed when its file comes in, so that asking for them reads no nodes at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from canopy.nodes import NODE_SCHEMA
from canopy.operators.lookup import Globs, scan_nodes
from canopy.operators.metrics import function_metrics, hotspots_of
from canopy.streaming.parts import Kind, Parts, remove

# A re-read row: a node, the version of its file, and whether the file is gone.
CHANGE_SCHEMA = T.StructType(
    [
        *[T.StructField(f.name, f.dataType) for f in NODE_SCHEMA.fields],
        T.StructField("version", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)
INDEX_SCHEMA = "file_path string, version bigint, deleted boolean"
# Rows of a version that came in, repeated ones included, and how many it has as far as its root is known.
TALLY_SCHEMA = "file_path string, version bigint, arrived bigint, expected bigint, deleted boolean"
METRICS_SCHEMA = """file_path string, node_id bigint, name string, start_line int, lines int, cyclomatic bigint, conditionals bigint,
    loops bigint, return_count bigint, max_depth int, version bigint"""
VERSION = ["file_path", "version"]
NODE = [*VERSION, "node_id"]


def changes_of(nodes: DataFrame, version: int) -> DataFrame:
    """Nodes as change rows of one version."""
    return nodes.withColumns({"version": F.lit(version).cast("bigint"), "deleted": F.lit(False)})


def deletions_of(files: DataFrame, version: int) -> DataFrame:
    """Removed files (file_path) as change rows of one version."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields if f.name != "file_path"]
    return files.select("file_path", *blank, F.lit(version).cast("bigint").alias("version"), F.lit(True).alias("deleted"))


def _newest(index: DataFrame) -> DataFrame:
    """(file_path, version, deleted) of the newest whole version of each file."""
    newest = index.groupBy("file_path").agg(F.max(F.struct("version", "deleted")).alias("v"))
    return newest.select("file_path", "v.version", "v.deleted")


def _newer_than(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of versions above the one that the index has of their file."""
    known = index.groupBy("file_path").agg(F.max("version").alias("_has"))
    return rows.join(known, "file_path", "left").where("_has is null or version > _has").drop("_has")


def _named(rows: DataFrame, index: DataFrame) -> DataFrame:
    return rows.join(_newest(index).where("not deleted").select(*VERSION), VERSION, "left_semi")


def _repeat(rows: DataFrame) -> bool:
    """Whether a node may be there twice. Equal nodes have equal hashes, so that no other column is read or dealt out."""
    node = F.xxhash64(*NODE)
    n = rows.agg(F.count("*").alias("rows"), F.count_distinct(node).alias("nodes")).first()
    return n.rows != n.nodes


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows that are stored, each node once; they are only dealt out and sorted where one repeats."""
    return rows.dropDuplicates(NODE) if _repeat(rows) else rows


def _tally(rows: DataFrame) -> DataFrame:
    """A version is not whole before ``arrived`` has reached ``expected``: one counts repeats, the other one root at most."""
    root = F.max(F.when(F.col("depth") == 0, F.col("descendant_count") + 1))
    return rows.groupBy(*VERSION).agg(F.count("*").alias("arrived"), root.alias("expected"), F.max("deleted").alias("deleted"))


def _added_up(tally: DataFrame) -> DataFrame:
    return tally.groupBy(*VERSION).agg(
        F.sum("arrived").alias("arrived"), F.max("expected").alias("expected"), F.max("deleted").alias("deleted")
    )


def node_parts(spark: SparkSession, root: str) -> Parts:
    """The tables under ``root``; merging drops rows that the index has left behind."""
    return Parts(
        spark,
        root,
        {
            "index": Kind(INDEX_SCHEMA, lambda rows, _: _newest(rows)),
            "tally": Kind(TALLY_SCHEMA, lambda rows, parts: _newer_than(_added_up(rows), parts.read("index"))),
            "open": Kind(CHANGE_SCHEMA, lambda rows, parts: _newer_than(_distinct(rows), parts.read("index"))),
            "nodes": Kind(CHANGE_SCHEMA, lambda rows, parts: _named(rows, parts.read("index"))),
            "metrics": Kind(METRICS_SCHEMA, lambda rows, parts: _named(rows, parts.read("index"))),
        },
    )


def _measured(nodes: DataFrame) -> DataFrame:
    """Measures of the functions in change rows, one version of each file."""
    versions = nodes.select(*VERSION).distinct()
    return function_metrics(nodes).join(versions, "file_path")


def _whole(rows: DataFrame) -> DataFrame:
    """(file_path, version, deleted) of the newest version of each file that ``rows`` hold whole.

    A version is whole when it has as many nodes as its root nodes say, so a
    large file may arrive over several batches without being seen half done.
    """
    expected = F.sum(F.when(F.col("depth") == 0, F.col("descendant_count") + 1))
    versions = rows.groupBy(*VERSION).agg(
        F.max("deleted").alias("deleted"), ((expected == F.count("*")) | F.max("deleted")).alias("whole")
    )
    return _newest(versions.where("whole"))


def take_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Take one batch of change rows into the tables under ``root``; a batch taken before is passed over."""
    spark = batch.sparkSession
    parts = node_parts(spark, root)
    if batch_id <= parts.batch:
        return
    work = f"{root}/work/{uuid.uuid4().hex}"
    index = parts.read("index")
    fresh = _newer_than(batch.select(*CHANGE_SCHEMA.fieldNames()), index)
    # Written once: while nothing is whole, these rows and their tally are the new parts as they are.
    opened, counts = parts.new_part("open"), parts.new_part("tally")
    fresh.write.parquet(parts.path(opened))
    fresh = spark.read.schema(CHANGE_SCHEMA).parquet(parts.path(opened))
    # Tables begun before there was a tally get one of their open rows.
    counted = any(part.kind == "tally" for part in parts.live)
    added = _tally(fresh) if counted else _tally(fresh.unionByName(parts.read("open")))
    added.write.parquet(parts.path(counts))
    added = spark.read.schema(TALLY_SCHEMA).parquet(parts.path(counts))
    asked = added.select(*VERSION).join(fresh.select(*VERSION).distinct(), VERSION, "left_semi")
    known = _added_up(parts.read("tally").join(asked, VERSION, "left_semi").unionByName(added))
    maybe = known.join(asked, VERSION, "left_semi").where("deleted or arrived >= expected").select(*VERSION, "arrived")
    maybe.write.parquet(f"{work}/maybe")
    maybe = spark.read.schema("file_path string, version bigint, arrived bigint").parquet(f"{work}/maybe")
    if maybe.isEmpty():
        parts.publish(batch_id, {"tally": counts, "open": opened})
        remove(spark, work)
        return
    # A version may be delivered again, over this batch or earlier ones.
    candidates = fresh.unionByName(parts.read("open")).join(maybe, VERSION, "left_semi")
    candidates.write.parquet(f"{work}/seen")
    seen = spark.read.schema(CHANGE_SCHEMA).parquet(f"{work}/seen")
    if _repeat(seen):
        seen.dropDuplicates(NODE).write.parquet(f"{work}/once")
        seen = spark.read.schema(CHANGE_SCHEMA).parquet(f"{work}/once")
    _whole(seen).write.parquet(f"{work}/whole")
    whole = spark.read.schema(INDEX_SCHEMA).parquet(f"{work}/whole")
    # Repeats are taken off the tally of what was looked at, so that it is next looked at when as much is there as it lacks.
    exact = seen.groupBy(*VERSION).agg(F.count("*").alias("n"), F.sum(F.when(F.col("depth") == 0, F.col("descendant_count") + 1)).alias("expected"))
    less = exact.join(maybe, VERSION).select(*VERSION, (F.col("n") - F.col("arrived")).alias("arrived"), "expected", F.lit(None).cast("boolean").alias("deleted"))
    named = _named(seen, whole)
    parts.publish(
        batch_id,
        {"index": whole, "tally": _newer_than(added.unionByName(less), whole), "open": _newer_than(fresh, whole), "nodes": named, "metrics": _measured(named)},
    )
    remove(spark, work)


def start_refresh(
    spark: SparkSession, incoming: str, root: str, *, files_per_batch: int = 1_000
) -> StreamingQuery:
    """Follow a folder of change rows (Parquet) into the tables at ``root`` until all there is has been taken."""
    stream = (
        spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    )
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: take_batch(batch, batch_id, root))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


def current_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The node table as of the newest whole version of each file."""
    parts = node_parts(spark, root)
    return _named(parts.read("nodes"), parts.read("index")).select(*NODE_SCHEMA.fieldNames())


def current_metrics(spark: SparkSession, root: str) -> DataFrame:
    """``function_metrics`` of the current node table, from what was kept; no nodes are read."""
    parts = node_parts(spark, root)
    return _named(parts.read("metrics"), parts.read("index")).drop("version")


def current_hotspots(spark: SparkSession, root: str, file_pattern: Globs = "**", n: int = 20) -> DataFrame:
    """The n most complex functions of the current node table, as ``complexity_hotspots`` has them."""
    return hotspots_of(scan_nodes(current_metrics(spark, root), file_pattern), n)


def compact(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Write the tables at ``root``, each as one part, as the beginning of new ones at ``target``.

    Versions keep their numbers and deletions their rows, so what arrives late there loses as it would here, and versions
    that are not whole go on. The old tables stay as they are until the caller drops them.
    """
    old = node_parts(spark, root)
    index = old.read("index")
    packed = {
        "index": _newest(index),
        "tally": _newer_than(_tally(old.read("open").dropDuplicates(NODE)), index),
        "open": _newer_than(old.read("open").dropDuplicates(NODE), index),
        "nodes": _named(old.read("nodes"), index),
        "metrics": _named(old.read("metrics"), index),
    }
    node_parts(spark, target).publish(-1, packed)
    return current_nodes(spark, target)
