"""The smallest range that contains each point, per key.

Each range is registered at the aligned blocks that cover it, keeping only the
best range per block. A point then asks its own block on every level. There is
no range test left in the join, and a crowded block costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.plans.blocks import Grid
from canopy.session import written

# Single lines, 64 lines, 4,096 lines. A longer scope lists its top blocks one
# by one, so that no block is asked by more points than that.
LINES = Grid(base=0, step=6, levels=3)
BITS = 31
# Questions that one task joins, whatever their compressed size.
TASK_ROWS = 500_000


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str, last: str) -> DataFrame:
    """Distinct (keys, point) with ``first`` and ``last`` of the best containing range, or NULL.

    The smallest range is best, among equal sizes the one that starts later.
    Both fit into one number, so all aggregates here stay on plain bigints.
    Bounds must be ints from 0 up.
    """
    rank = f"shiftleft(bigint({last} - {first}), {BITS}) + ({(1 << BITS) - 1}L - {first})"
    wanted = written(points.select(*keys, point).distinct())  # read twice below
    tasks = max(1, -(-wanted.count() * LINES.levels // TASK_ROWS))
    at = (*keys, "level", "block")
    registered = (
        ranges.select(*keys, first, last)
        .distinct()
        .select(*keys, F.expr(rank).alias("rank"), F.explode(LINES.cover(first, last)).alias("_at"))
        .select(*keys, "rank", "_at.level", "_at.block")
        .repartition(tasks, *at)
        .groupBy(*at)
        .agg(F.min("rank").alias("rank"))
    )
    asked = wanted.select(*keys, point, F.explode(LINES.all_blocks(point)).alias("_at")).select(
        *keys, point, "_at.level", "_at.block"
    ).repartition(tasks, *at)
    # min() skips NULL, so the points themselves keep the unmatched ones alive.
    unmatched = wanted.withColumn("rank", F.lit(None).cast("bigint"))
    # Both sides are far larger than their source files; do not let an estimate broadcast one.
    hits = asked.join(registered.hint("merge"), list(at)).select(*keys, point, "rank")
    best = hits.unionByName(unmatched).groupBy(*keys, point).agg(F.min("rank").alias("rank"))
    start = f"int({(1 << BITS) - 1}L - (rank & {(1 << BITS) - 1}L))"
    return best.selectExpr(
        *keys, point, f"{start} as {first}", f"int({start} + shiftright(rank, {BITS})) as {last}"
    )
