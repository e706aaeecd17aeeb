"""Write counted rows out again, in order, without one task writing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Copies of one row written out per task turn.
BLOCK = 65_536


def copies_in_order(counted: DataFrame, times: str, order: list[str | Column]) -> DataFrame:
    """Rows sorted by ``order``, each ``times`` times; ``times`` is dropped.

    A row is first split into blocks of copies. The sort's own range exchange
    spreads the blocks, and each is written out where it lands.
    """
    block = F.explode(F.expr(f"sequence(0L, ({times} - 1) div {BLOCK})"))
    blocks = counted.withColumn("_block", block).orderBy(*order, "_block")
    copy = F.explode(F.expr(f"sequence(1L, least({BLOCK}L, {times} - _block * {BLOCK}))"))
    return blocks.withColumn("_copy", copy).drop("_block", "_copy", times)
