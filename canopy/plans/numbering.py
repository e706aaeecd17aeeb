"""Running totals and row numbers that survive a hot key.

A plain window puts one key into one task. That is the cheapest plan while
every key is small, and a stuck job once a key holds a third of the rows. So
the size of the largest key is looked up first (one partial aggregate over the
key columns, one number to the driver) and the plan is chosen from it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import written

# A key up to this many rows is left to one task (it may spill there).
HOT_ROWS = 5_000_000
# Rows per slice of the range-partitioned plan.
SLICE_ROWS = 1_000_000
# Groups that keys are hashed to where a bound of their size is enough.
KEY_GROUPS = 65_536
# Copies of one identical row written out per task.
COPY_BLOCK = 65_536


class KeySizes(NamedTuple):
    """Rows of the largest key, and rows in all."""

    largest: int
    total: int


def key_sizes(df: DataFrame, keys: list[str]) -> KeySizes:
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    top = per_key.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return KeySizes(top.largest or 0, top.total or 0)


def key_bound(df: DataFrame, keys: list[str]) -> KeySizes:
    """An upper bound of the largest key, and the rows in all: keys are counted by hash, in KEY_GROUPS numbers."""
    return key_sizes(df.select(F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("_group")), ["_group"])


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str | None,
    out: str,
    *,
    sizes: KeySizes | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same key.

    ``value=None`` counts rows. ``order`` must decide between any two rows
    that differ. ``sizes`` may hand in an upper bound that is cheaper to find
    than the key sizes of ``df``.
    """
    top = sizes if sizes is not None else key_sizes(df, keys)
    amount = F.coalesce(F.col(value), F.lit(0)).cast("bigint") if value else F.lit(1).cast("bigint")
    if top.largest <= hot_rows:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(amount).over(earlier), F.lit(0).cast("bigint")))
    slices = max(2, -(-top.total // min(SLICE_ROWS, hot_rows)))
    return _sliced_sum(df, keys, order, amount, out, slices)


def _sliced_sum(df: DataFrame, keys: list[str], order: list[str], amount: Column, out: str, slices: int) -> DataFrame:
    """Sort into range slices, sum inside each, and carry the totals forward.

    Identical rows are folded into one with a count first, because a range
    partitioner cannot split equal sort keys.
    """
    columns = df.columns
    folded = df.withColumn("_amount", amount).groupBy(*columns, "_amount").agg(F.count("*").alias("_copies"))
    sliced = written(
        folded.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    weight = F.col("_amount") * F.col("_copies")
    by_slice = sliced.groupBy("_slice", *keys).agg(F.sum(weight).alias("_total"))
    # At most one row per slice and key, and a key has no more rows here than there are slices.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.select("_slice", *keys, F.sum("_total").over(before).alias("_carry")).where("_carry is not null")
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0).cast("bigint")))
    # Only the key a slice begins with can have a carry, so this side has at most one row per slice.
    on = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_slice", *keys)])
    summed = (
        local.alias("l")
        .join(carried.alias("c"), on, "left")
        .select("l.*", (F.col("_local") + F.coalesce("_carry", F.lit(0).cast("bigint"))).alias("_before"))
    )
    return _unfold(summed, columns, out, slices)


def _unfold(summed: DataFrame, columns: list[str], out: str, slices: int) -> DataFrame:
    """Write folded copies out again, a bounded block of them per row and task."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPY_BLOCK))
    blocked = summed.withColumn("_block", F.explode(blocks))
    spread = blocked.repartition(slices, *columns, "_block")
    first = F.col("_block") * COPY_BLOCK
    last = F.least(first + COPY_BLOCK, F.col("_copies")) - 1
    each = spread.withColumn("_copy", F.explode(F.sequence(first, last)))
    return each.select(*columns, (F.col("_before") + F.col("_copy") * F.col("_amount")).alias(out))


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str,
    *,
    sizes: KeySizes | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the 1-based row number inside the key."""
    counted = running_sum(df, keys, order, None, out, sizes=sizes, hot_rows=hot_rows)
    return counted.withColumn(out, F.col(out) + 1)
