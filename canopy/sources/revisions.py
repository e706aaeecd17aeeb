"""Many revisions of a node table in the space of their changes.

A file's nodes are written in the revision that added or changed them, and hold until the revision in which the file has its
next entry. So a revision adds the nodes of its changed files, and one small entry per changed file: its hash, or that it is
gone. Any revision is read by taking, per file, the last entry up to it, and the nodes of these entries. Two revisions are
compared by their entries first; only files that differ are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.nodes import NODE_SCHEMA, clustered
from canopy.operators.diff import structural_diff
from canopy.operators.lookup import Globs, scan_nodes
from canopy.session import written
from canopy.sources.corpus import file_changes, node_manifest
from canopy.streaming.parts import names_in

ENTRY = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("revision", T.LongType()),
    ]
)
_NODES = T.StructType([*NODE_SCHEMA.fields, T.StructField("revision", T.LongType())])


class RevisionStore:
    """Revisions under ``root``, numbered upwards. One writer at a time.

    Entries are written after the nodes, and a revision is there once Spark has marked their folder as whole; a crashed
    commit is not seen and its next try overwrites it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def revisions(self) -> list[int]:
        """The numbers of all revisions, ascending."""
        folders = [name for name in names_in(self.spark, f"{self.root}/entries") if name.startswith("revision=")]
        whole = [name for name in folders if "_SUCCESS" in names_in(self.spark, f"{self.root}/entries/{name}")]
        return sorted(int(name.split("=")[1]) for name in whole)

    def _folders(self, kind: str, up_to: int) -> list[str]:
        return [f"{self.root}/{kind}/revision={number}" for number in self.revisions() if number <= up_to]

    def _read(self, kind: str, schema: T.StructType, up_to: int) -> DataFrame:
        folders = self._folders(kind, up_to)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*folders)

    def entries(self, revision: int) -> DataFrame:
        """(file_path, content_hash, revision) of the files that a revision has; ``revision`` is where their nodes came in."""
        last = self._read("entries", ENTRY, revision).groupBy("file_path").agg(F.max(F.struct("revision", "status", "content_hash")).alias("e"))
        return last.where("e.status <> 'deleted'").select("file_path", "e.content_hash", "e.revision")

    def manifest(self, revision: int) -> DataFrame:
        """(file_path, content_hash) of a revision."""
        return self.entries(revision).select("file_path", "content_hash")

    def commit(self, nodes: DataFrame, revision: int) -> None:
        """Add a node table as revision ``revision``; a revision that is there already is left as it is."""
        done = self.revisions()
        if revision in done:
            return
        if done and revision < done[-1]:
            raise ValueError(f"revision {revision} is below the last one, {done[-1]}")
        manifest = written(node_manifest(nodes))  # one small row per file, used twice
        changes = file_changes(self.manifest(revision), manifest).join(manifest, "file_path", "left").select("file_path", "status", "content_hash")
        # Entries are computed once, aside, and copied last.
        aside = f"{self.root}/changes/revision={revision}"
        changes.write.mode("overwrite").parquet(aside)
        changes = self.spark.read.schema(T.StructType(ENTRY.fields[:-1])).parquet(aside)
        touched = changes.where("status <> 'deleted'").select("file_path")
        rows = nodes.select(*(F.col(f.name) if f.name in nodes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields))
        clustered(rows.join(touched, "file_path", "left_semi")).write.mode("overwrite").parquet(f"{self.root}/nodes/revision={revision}")
        changes.write.mode("overwrite").parquet(f"{self.root}/entries/revision={revision}")

    def _nodes_of(self, entries: DataFrame, up_to: int) -> DataFrame:
        nodes = self._read("nodes", _NODES, up_to)
        return nodes.join(entries.select("file_path", "revision"), ["file_path", "revision"], "left_semi").select(*NODE_SCHEMA.fieldNames())

    def at(self, revision: int) -> DataFrame:
        """The node table of a revision."""
        return self._nodes_of(self.entries(revision), revision)

    def changes(self, old: int, new: int) -> DataFrame:
        """(file_path, status) between two revisions, from their entries alone."""
        return file_changes(self.manifest(old), self.manifest(new))

    def pair(self, old: int, new: int, file: Globs = "**") -> tuple[DataFrame, DataFrame]:
        """The nodes of both revisions in the files that differ."""
        differ = scan_nodes(self.changes(old, new), file).select("file_path")
        return tuple(self._nodes_of(self.entries(at).join(differ, "file_path", "left_semi"), at) for at in (old, new))

    def diff(self, old: int, new: int, file: Globs = "**", *, changed_only: bool = False) -> DataFrame:
        """``structural_diff`` between any two revisions.

        ``changed_only`` reads the files that differ alone. In the others ``structural_diff`` has rows only where a name
        repeats: it compares every old definition of a name with every new one.
        """
        sides = self.pair(old, new, file) if changed_only else (self.at(old), self.at(new))
        return structural_diff(*sides, file)

    def tagged(self, *revisions: int) -> DataFrame:
        """Some revisions as one table with a ``snapshot_id``, the number as text."""
        out = None
        for number in revisions:
            rows = self.at(number).withColumn("snapshot_id", F.lit(str(number)))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("name at least one revision")
        return out
