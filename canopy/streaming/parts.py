"""Tables that a stream adds to batch by batch, kept as few parts that are merged level by level.

Each batch adds one part per table. When FAN_OUT parts of a level have come together they are merged into one part of the
next level, so that n batches leave at most ``(FAN_OUT - 1) * log(n)`` parts to read, and a row is written again
``log(n)`` times. What is live is told by a manifest that lists the parts of all tables: it is written last, as one file under
the number of its batch, and parts are never changed. So a batch counts whole or not at all, a replayed batch that was
published before is passed over, and a crash leaves at most folders that no manifest names. The manifest before the live
one and its parts stay for readers that have just looked; what is older is removed.

One stream writes a root at a time, as its checkpoint sees to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Parts of one level that make one of the next.
FAN_OUT = 4
MANIFEST = "batch bigint, kind string, level int, folder string"


@dataclass(frozen=True)
class Kind:
    """One of the tables: its schema, and how the rows of several parts become those of one."""

    schema: T.StructType | str
    merge: Callable[[DataFrame, "Parts"], DataFrame]


@dataclass(frozen=True, order=True)
class Part:
    kind: str
    level: int
    folder: str


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    files, folder = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _file_system(spark, path)
    files.delete(folder, True)


class Parts:
    """The tables ``kinds`` under ``root`` as of the last published batch."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind]) -> None:
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds
        self._manifests = f"{self.root}/manifest"
        published = self._published()
        self.batch = int(published[-1]) - 1 if published else -2
        self.live = self._listed(published[-1]) if published else []

    def _published(self) -> list[str]:
        # Spark marks a folder whose files are all there.
        return [name for name in names_in(self.spark, self._manifests) if "_SUCCESS" in names_in(self.spark, f"{self._manifests}/{name}")]

    def _listed(self, name: str) -> list[Part]:
        rows = self.spark.read.schema(MANIFEST).json(f"{self._manifests}/{name}").where("kind is not null").collect()
        return sorted(Part(row.kind, row.level, row.folder) for row in rows)

    def _read(self, kind: str, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.kinds[kind].schema)
        return self.spark.read.schema(self.kinds[kind].schema).parquet(*map(self.path, parts))

    def read(self, kind: str) -> DataFrame:
        """The rows of all live parts of a table, not merged."""
        return self._read(kind, [part for part in self.live if part.kind == kind])

    def new_part(self, kind: str, level: int = 0) -> Part:
        """A part that the caller writes to its ``path`` before it publishes it; without that it is removed with the next batch."""
        return Part(kind, level, f"{kind}-{level}-{uuid.uuid4().hex}")

    def path(self, part: Part) -> str:
        return f"{self.root}/parts/{part.folder}"

    def _write(self, kind: str, level: int, rows: DataFrame) -> Part:
        part = self.new_part(kind, level)
        rows.write.mode("error").parquet(self.path(part))
        return part

    def _merged(self, kind: str) -> None:
        """Merge full levels, all that fall together at once."""
        taken: list[Part] = []
        level = 0
        while len(own := [p for p in self.live if p.kind == kind and p.level == level]) + bool(taken) >= FAN_OUT:
            taken += own
            level += 1
        if taken:
            kept = [p for p in self.live if p not in taken]
            part = self._write(kind, level, self.kinds[kind].merge(self._read(kind, taken), self))
            self.live = sorted([*kept, part])

    def publish(self, batch: int, added: dict[str, DataFrame | Part]) -> None:
        """Add a part, of rows or written before, to each table as batch ``batch``; one that was published before is passed over.

        Tables are merged in the order of ``kinds``; a merge sees what was merged before it.
        """
        if batch <= self.batch:
            return
        before = self.live
        self.live = sorted([*before, *(new if isinstance(new, Part) else self._write(kind, 0, new) for kind, new in added.items())])
        for kind in self.kinds:
            self._merged(kind)
        rows = [(batch, part.kind, part.level, part.folder) for part in self.live]
        # Numbers from 0 on, of one width, so that names sort like batches; -1 is a table's given beginning.
        name = f"{batch + 1:020d}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self._manifests}/{name}")
        self.batch = batch
        self._tidy({part.folder for part in [*before, *self.live]})

    def _tidy(self, needed: set[str]) -> None:
        """Remove all but the last two manifests, and parts that neither of them names."""
        published = self._published()
        for name in published[:-2]:
            remove(self.spark, f"{self._manifests}/{name}")
        for folder in names_in(self.spark, f"{self.root}/parts"):
            if folder not in needed:
                remove(self.spark, f"{self.root}/parts/{folder}")
