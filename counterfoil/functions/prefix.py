"""Skew-safe running sums per key.

``F.sum(x).over(Window.partitionBy(key).orderBy(pos))`` puts every row of
a key into one task; if one product holds a third of all order lines, one
task does a third of the work.  Here the ordering column is cut into
blocks of ``width`` consecutive positions, and the sum is taken in two
levels:

1. within (key, block), a window over at most ``width`` rows (positions are
   unique per key);
2. per key, a window over the block *totals* (one row per non-empty
   block, at most ``range / width`` rows);

and the block offset is joined back on (key, block).  With
``width ~ sqrt(range)`` neither level holds more than about ``sqrt(range)``
rows of one key, whatever the skew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_width_for(position_range: int) -> int:
    return max(1, math.isqrt(max(position_range, 0)) + 1)


def exclusive_prefix_sums(df: DataFrame, key: str, pos: str, values: dict[str, str],
                          width: int, key_totals: dict[str, str] | None = None) -> DataFrame:
    """Add, for each ``out: col`` in ``values``, the sum of ``col`` over
    earlier rows (smaller ``pos``) of the same ``key``; positions must be
    unique within a key.  ``key_totals`` (``out: col``) adds the sum of
    ``col`` over all rows of the key, taken from the same block totals."""
    key_totals = key_totals or {}
    blk = F.floor(F.col(pos) / F.lit(width)).cast("long")
    df = df.withColumn("_blk", blk)
    within = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    for out, col in values.items():
        df = df.withColumn(f"_in_{out}", F.coalesce(F.sum(col).over(within), F.lit(0)))
    sums = {**{f"_tot_{out}": col for out, col in values.items()},
            **{f"_all_{out}": col for out, col in key_totals.items()}}
    totals = df.groupBy(key, "_blk").agg(*[F.sum(col).alias(name) for name, col in sums.items()])
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    offsets = totals.select(key, "_blk", *[
        F.coalesce(F.sum(f"_tot_{out}").over(before), F.lit(0)).alias(f"_off_{out}")
        for out in values], *[F.sum(f"_all_{out}").over(whole).alias(out) for out in key_totals])
    joined = df.join(offsets, [key, "_blk"])
    for out in values:
        joined = joined.withColumn(out, F.col(f"_in_{out}") + F.col(f"_off_{out}"))
    drop = ["_blk"] + [f"_{p}_{o}" for o in values for p in ("in", "off")]
    return joined.drop(*drop)
