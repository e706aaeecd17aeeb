"""From files to a refreshed node table in one go: scan, find what changed, re-read it, replace it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.sources.corpus import file_changes
from canopy.sources.markup import markup_nodes, markup_rejects
from canopy.sources.stores import refresh


class Refreshed(NamedTuple):
    """The new node table, the manifest to keep for the next time, and the files that could not be read."""

    nodes: DataFrame
    manifest: DataFrame
    rejects: DataFrame


def refresh_from_files(nodes: DataFrame, known: DataFrame, files: DataFrame, *, peek: int | str = 200) -> Refreshed:
    """Bring a node table of markup files up to date.

    ``known`` (file_path, content_hash) is the manifest of the last time, ``files`` (file_path, text) a scan. Only files
    whose text changed are parsed. A changed file that breaks the markup rule leaves the table and is a reject.
    """
    manifest = files.select("file_path", F.sha2("text", 256).alias("content_hash"))
    changes = file_changes(known, manifest)
    touched = changes.where("status <> 'deleted'").select("file_path")
    pages = files.join(touched, "file_path", "left_semi").select(F.col("file_path").alias("url"), F.col("text").alias("html"))
    return Refreshed(refresh(nodes, changes, markup_nodes(pages, peek=peek)), manifest, markup_rejects(pages))
