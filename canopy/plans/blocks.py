"""Aligned blocks: the shared way to join ranges with points at any size.

An integer range is covered by aligned blocks, small ones at its ends and
large ones in between, like the blocks of a segment tree with a wide fan-out.
A range-to-point relation then becomes an equi-join on (keys, level, block),
and no join ever has to test a range against a whole file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Blocks of ``2**base`` numbers, grouped ``2**step`` at a time, ``levels`` times."""

    base: int
    step: int
    levels: int

    def shift(self, level: int) -> int:
        return self.base + self.step * level

    def block_of(self, position: str, level: int = 0) -> str:
        return f"shiftright(bigint({position}), {self.shift(level)})"

    def all_blocks(self, position: str) -> Column:
        """Every (level, block) that contains one position."""
        return F.expr(self.all_blocks_sql(position))

    def all_blocks_sql(self, position: str) -> str:
        blocks = [_block(level, self.block_of(position, level)) for level in range(self.levels)]
        return f"array({', '.join(blocks)})"

    def parents(self, block: str) -> Column:
        """The (level, block) of a level-0 block and of all that contain it."""
        blocks = [_block(level, f"shiftright({block}, {self.step * level})") for level in range(self.levels)]
        return F.expr(f"array({', '.join(blocks)})")

    def cover(self, first: str, last: str) -> Column:
        """The (level, block) array that exactly covers level-0 blocks first..last.

        At most two runs of ``2**step`` blocks per level; only the top level
        may hold a longer run. An empty range gives an empty array.
        """
        return F.expr(self.cover_sql(first, last))

    def cover_sql(self, first: str, last: str) -> str:
        mask = (1 << self.step) - 1
        low, high = f"bigint({first})", f"bigint({last})"
        runs: list[str] = []
        for level in range(self.levels - 1):
            group_end = f"({low} | {mask}L)"
            runs.append(_run(level, low, f"least({group_end}, {high})", f"{low} <= {high}"))
            tail = f"greatest({high} & ~{mask}L, {group_end} + 1)"
            runs.append(_run(level, tail, high, f"{low} <= {high} and {tail} <= {high}"))
            # What lies between the two end groups moves up one level. Once
            # nothing is left, low stays above high on all further levels.
            low, high = f"(shiftright({low}, {self.step}) + 1)", f"(shiftright({high}, {self.step}) - 1)"
        runs.append(_run(self.levels - 1, low, high, f"{low} <= {high}"))
        return f"concat({', '.join(runs)})"


# The expressions are SQL text, because each level refers to the one below it.
def _block(level: int, block: str) -> str:
    return f"named_struct('level', {level}, 'block', {block})"


def _run(level: int, low: str, high: str, unless_empty: str) -> str:
    blocks = f"transform(sequence({low}, {high}), b -> {_block(level, 'b')})"
    return f"case when {unless_empty} then {blocks} else cast(array() as array<struct<level:int,block:bigint>>) end"
