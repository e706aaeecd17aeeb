"""Tables that are rebuilt, refreshed or replaced by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.nodes import clustered
from canopy.operators.planning import PLANNING_SCHEMA
from canopy.session import written


def refresh(nodes: DataFrame, manifest: DataFrame, reread: DataFrame, *, keep_deleted: bool = False) -> DataFrame:
    """Replace the files of a node table that changed.

    ``manifest`` (file_path, status) lists what changed. Rows of listed files
    go, re-read rows of added and modified files come in. Deleted files leave
    the table too, unless ``keep_deleted``. The manifest is written out first: by its size as a file a short one is
    broadcast, while its estimate as a plan would send all nodes of a file to one task.
    """
    manifest = written(manifest.select("file_path", "status"))
    gone = manifest.where(~F.col("status").isin("deleted")) if keep_deleted else manifest
    current = manifest.where(F.col("status").isin("added", "modified"))
    kept = nodes.join(gone.select("file_path"), "file_path", "left_anti")
    fresh = reread.join(current.select("file_path"), "file_path", "left_semi")
    return kept.unionByName(fresh)


def replace_by_key(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert: rows of ``updates`` win over rows of ``base`` with the same key."""
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def rebuild(nodes: DataFrame, path: str, *, by_folder: bool = False) -> DataFrame:
    """Create or replace the node table at ``path``, optionally partitioned by first folder."""
    laid_out = clustered(nodes)
    if by_folder:
        laid_out = laid_out.withColumn("folder", F.substring_index("file_path", "/", 1))
    writer = laid_out.write.mode("overwrite")
    (writer.partitionBy("folder") if by_folder else writer).parquet(path)
    return nodes.sparkSession.read.parquet(path)


class VersionedTable:
    """A table whose content is swapped as a whole: each write is a new folder, a pointer names the live one.

    Readers keep their version while a new one is written, and a failed write
    leaves the live version as it was.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._pointer = f"{self.root}/_live"

    def _live(self) -> tuple[int, str] | None:
        """Number and folder of the live version."""
        if not table_exists(self.spark, self._pointer):
            return None
        rows = self.spark.read.schema("seq bigint, version string").json(self._pointer)
        last = rows.orderBy(F.desc("seq"), F.desc("version")).first()
        return last.seq, f"{self.root}/{last.version}"

    def read(self) -> DataFrame:
        """The live rows; a table never written is empty."""
        live = self._live()
        if live is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(live[1])

    def write(self, rows: DataFrame, seq: int | None = None) -> None:
        """Publish ``rows`` as version ``seq`` (by default the next one); the highest is live, on a tie the later name."""
        if seq is None:
            live = self._live()
            seq = live[0] + 1 if live else 1
        version = f"v{seq:010d}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.root}/{version}")
        pointer = self.spark.createDataFrame([(seq, version)], "seq bigint, version string")
        pointer.coalesce(1).write.mode("append").json(self._pointer)


def write_planning_context(spark: SparkSession, path: str, tasks: Iterable[str], *captures: DataFrame) -> None:
    """Replace the pinned symbols of exactly the given tasks by those in ``captures`` (one per role, say), all in one go.

    A task without captured symbols is emptied; other tasks stay. The store is swapped as a whole.
    """
    tasks = list(tasks)
    store = VersionedTable(spark, path, PLANNING_SCHEMA)
    rows = store.read().where(~F.col("task_id").isin(*tasks)) if tasks else store.read()
    for captured in captures:
        rows = rows.unionByName(captured.where(F.col("task_id").isin(*tasks)))
    store.write(rows)


def read_planning_context(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(spark, path, PLANNING_SCHEMA).read()


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """Whether a catalog table, or a table folder, is there to be read."""
    if "/" not in name_or_path:
        return spark.catalog.tableExists(name_or_path)
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(name_or_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
