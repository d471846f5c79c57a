"""Exact money arithmetic.

``quantity * price`` is INT x DECIMAL(8,2) -> DECIMAL(19,2); sums widen to
DECIMAL(29,2).  Report columns are cast to ``MONEY`` (DECIMAL(38,2)) so that
every report has one money type, and no double ever holds an amount.
Where the price is constant within a group, sum the quantities first and
multiply once: exact, and it keeps the wide-decimal work off the hot path.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import MONEY


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_value(quantity: str | Column = "quantity", price: str | Column = "price") -> Column:
    """Value of one order line at the current price (no price on the line)."""
    return col_(quantity) * col_(price)


def as_money(c: str | Column) -> Column:
    return col_(c).cast(MONEY)


def money_lit(value) -> Column:
    return F.lit(Decimal(str(value))).cast(MONEY)


def meets(c: str | Column, threshold, inclusive: bool) -> Column:
    """``c >= threshold`` when inclusive, else ``c > threshold``."""
    t = money_lit(threshold)
    return col_(c) >= t if inclusive else col_(c) > t
