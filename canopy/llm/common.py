"""What several operators share: table access, durable intermediates, folds, bounded Arrow work and components.

Defined cases: every helper takes null texts as absent, and keeps repeated rows.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import written

#: Bounds of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

#: What empties the caches that an operator's module leaves in a worker, by module.
emptied_by: dict[str, Callable[[], None]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def prepare(spark: SparkSession) -> None:
    """Session settings of the operators: bounded Arrow batches, shuffle files removed with their query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    return written(df)


def fold(doc_id) -> F.Column:
    """The fold of a row, 0 to 4. A row without an id has fold 0, which is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def empty_other_caches(module: str) -> None:
    """A worker is used again by whatever operator comes next, so it keeps the caches of one operator at a time."""
    for other, empty in emptied_by.items():
        if other != module:
            empty()


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would hold it beside the active ones."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``function`` over the record batches of ``df``; both sides stay bounded by the batch size.

    Between tasks a worker holds the caches of the operator it last worked for, and little else.
    """
    prepare(df.sparkSession)
    module = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_other_caches(module)
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from function(batch)
        finally:
            batch = None
            release()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list:
    """The texts of an Arrow string column as bytes, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of links ``(a, b)``: one row ``(node, label)`` per node, label the smallest node reached.

    Each round gives every node the smallest label among its own and its neighbours', then follows the label of that
    label (pointer jumping), so a chain of n nodes takes about log n rounds. Every step is an equi-join or an
    aggregate with partial sums; a hub of any degree is never gathered. Tables between rounds lie in the shared folder.
    Empty links give an empty result; loops and repeated links do no harm. Raises if ``rounds`` do not suffice.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    edges = pinned(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pinned(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # A label also pulls down the node it names, so that roots hang below smaller roots.
        pulled = near.join(labels, "node").select(F.col("label").alias("node"), F.col("near").alias("pull")).groupBy("node").agg(F.min("pull").alias("pull"))
        low = (
            labels.join(near, "node")
            .join(pulled, "node", "left")
            .select("node", F.col("label").alias("was"), F.least("label", "near", "pull").alias("label"))
        )
        low = pinned(low)
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = pinned(low.join(jump, "label", "left").select("node", "was", F.least("label", "next").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> list[tuple[bytes, int]]:
    """At most ``max_rows`` pairs (text, label) to learn from, outside fold 0, in an order that the ids decide.

    The sampled ids are sent to the tasks (``max_rows`` bounds them), so texts are not shuffled. Null labels, ids and
    texts are no examples; repeated rows may count as often as they occur.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    some = usable.select("doc_id", F.col(column).cast("int").alias("_label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_label", F.xxhash64("text")).limit(max_rows)
    return [(row.text.encode("utf-8"), row._label) for row in rows.collect()]
