"""Dense, increasing ids in a given order without a single-partition window.

A global ``row_number()`` moves every row into one task.  Instead the rows
are range-partitioned and sorted by the ordering column, tagged with
``monotonically_increasing_id()`` (partition index in the high bits, row
index in the low 33), and written to the checkpoint folder so both passes
see the same tags.  Per-partition counts (one row per partition, a
proven size bound) give each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_LOW_BITS = 33


def dense_index(df: DataFrame, order_col: str, out: str, start: int = 1,
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = start, start+1, ... following ascending ``order_col``
    (ties broken arbitrarily but consistently)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = stored(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
                    .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _LOW_BITS)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    low = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return (tagged.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn(out, F.lit(start) + F.col("_off") + low)
            .drop("_mid", "_part", "_off"))
