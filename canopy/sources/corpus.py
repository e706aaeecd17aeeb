"""File-level sources: corpus scans, manifests, changed files, dominant language."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.nodes import NODE_SCHEMA

# Folders never scanned, and the extensions a corpus is typed by.
EXCLUDED_FOLDERS = (".git", "vendor", "node_modules", "gen")
LANGUAGE_EXTENSIONS = ("go", "py", "ts", "tsx", "js", "rs", "cpp", "c", "java")


def _excluded(relative: Column) -> Column:
    return reduce(or_, [relative.startswith(f"{folder}/") for folder in EXCLUDED_FOLDERS])


def _scanned(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """All files with one extension but those of the excluded folders, whose content is never read.

    Spark lists the folders, in tasks where there are many. The exclusion asks the path of a file alone, so it is applied to
    the listing, and the plan is the same for any number of folders.
    """
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("_metadata.file_path"), base, -1)
    files = spark.read.format("binaryFile").options(pathGlobFilter=f"*.{extension}", recursiveFileLookup="true").load(base)
    kept = files.where(~_excluded(relative))
    return kept.select(F.substring_index(F.col("path"), base, -1).alias("file_path"), F.col("modificationTime").alias("modified_at"), "length", "content")


def _is_text() -> Column:
    return F.is_valid_utf8(F.col("content").cast("string"))


def scan_corpus(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Files under ``root`` with one extension: relative path, time, size and text. ``scan_rejects`` has the unreadable ones."""
    readable = _scanned(spark, root, extension).where(_is_text())
    return readable.select("file_path", "modified_at", "length", F.col("content").cast("string").alias("text"))


def scan_rejects(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(file_path, reason) of the files that a scan leaves out."""
    return _scanned(spark, root, extension).where(~_is_text()).select("file_path", F.lit("not UTF-8").alias("reason"))


def corpus_manifest(files: DataFrame) -> DataFrame:
    """(file_path, content_hash, modified_at) of a scanned corpus."""
    return files.select("file_path", F.sha2("text", 256).alias("content_hash"), "modified_at")


def changed_files(manifest: DataFrame, built_at: Column) -> DataFrame:
    """Files modified after the node table was built."""
    return manifest.where(F.col("modified_at") > built_at)


def latest_per_path(observations: DataFrame, path: str, at: str) -> DataFrame:
    """A manifest out of repeated sightings: the latest time per path."""
    return observations.groupBy(F.col(path).alias("file_path")).agg(F.max(at).alias("modified_at"))


def extension_of(path: Column) -> Column:
    """Lower-case extension of a path or URL, ``''`` without one."""
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)(?:[?#].*)?$", 1)


def dominant_extension(paths: DataFrame, path: str, extensions: Iterable[str] = LANGUAGE_EXTENSIONS) -> DataFrame:
    """The extension with most files and its count; equal counts go to the first by name."""
    counts = (
        paths.select(extension_of(F.col(path)).alias("extension"))
        .where(F.col("extension").isin(*extensions))
        .groupBy("extension")
        .agg(F.count("*").alias("files"))
    )
    return counts.orderBy(F.desc("files"), "extension").limit(1)


def node_manifest(nodes: DataFrame) -> DataFrame:
    """(file_path, content_hash) of a node table; the hash ignores row order and is combined map-side.

    Every column of a node counts, and a NULL differs from any value.
    """
    columns = [f.name for f in NODE_SCHEMA.fields if f.name != "file_path" and f.name in nodes.columns]
    row = F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])
    hashed = nodes.select("file_path", row.alias("h"))
    return hashed.groupBy("file_path").agg(
        F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor("h")), F.sum(F.pmod("h", F.lit(1 << 31))).cast("string"))
        .alias("content_hash")
    )


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status) between two manifests; unchanged files are left out."""
    pairs = old.select("file_path", F.col("content_hash").alias("old_hash")).join(
        new.select("file_path", F.col("content_hash").alias("new_hash")), "file_path", "full_outer"
    )
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return pairs.select("file_path", status.alias("status")).where("status is not null")


def at_snapshot(tagged: DataFrame, snapshot_id: str) -> DataFrame:
    """One revision of a snapshot-tagged node table."""
    return tagged.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
