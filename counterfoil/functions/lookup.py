"""Place of a value in a sorted list that the caller holds (job parameters)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_below(value: Column, ascending: list) -> Column:
    """How many of ``ascending`` are smaller than ``value`` (NULL for NULL).

    The list is cut into blocks of about the square root of its length: the
    block is found by its first items, the place by the block's own.
    """
    if not ascending:
        return F.when(value.isNotNull(), F.lit(0))
    width = math.isqrt(len(ascending) - 1) + 1
    items = F.array(*[F.lit(x) for x in ascending])
    heads = F.array(*[F.lit(x) for x in ascending[::width]])
    block = F.size(F.filter(heads, lambda h: h < value))
    inside = F.slice(items, F.greatest(block - 1, F.lit(0)) * width + 1, F.lit(width))
    return F.when(value.isNotNull(), F.when(block == 0, 0).otherwise(
        (block - 1) * width + F.size(F.filter(inside, lambda x: x < value))))
