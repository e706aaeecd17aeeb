"""Session helpers: where the durable intermediate tables go, and their lifetime.

Every table a plan has to pin (numbered rows with skewed keys, a built node
table) goes to the shared folder named by ``spark.checkpoint.dir``, so that a
lost executor never loses it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_pinned: dict[tuple, tuple] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as used by the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("canopy")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for pinned tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may go
    without: it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="canopy-")
    return _local_roots[app]


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"pinned-{spark.sparkContext.applicationId}", uuid.uuid4().hex)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting the lineage.

    Unlike ``df.checkpoint()`` this computes the rows once, keeps them columnar
    and lets later reads prune columns.
    """
    path = new_path(df.sparkSession)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned_table(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a table once per application and serve it from Parquet afterwards.

    The key must name the inputs. Tables are never shared between
    applications; within one, ``forget_pinned`` makes a changed input count.
    """
    app_key = (spark.sparkContext.applicationId, *key)
    if app_key not in _pinned:
        path = new_path(spark)
        df = build()
        df.write.mode("error").parquet(path)
        _pinned[app_key] = (path, df.schema)
    path, schema = _pinned[app_key]
    return spark.read.schema(schema).parquet(path)


def forget_pinned(*key: object) -> None:
    """Build tables anew on their next use: those whose key begins with ``key``, or all."""
    for own in [k for k in _pinned if k[1 : 1 + len(key)] == key]:
        del _pinned[own]
