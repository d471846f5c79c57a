"""Dates typed at the till: ``dd-MMM-yy`` text to DATE.

Spark's parser is strict where the console's was lenient: an impossible
day (``32-Jan-20``), trailing text (``17-Nov-20xyz``) and a four-digit year
(``17-Nov-2020``) give NULL, and the request is rejected.  Two-digit years
are placed in the 100-year window that starts 80 years before a *fixed*
reference date (so results repeat), the rule the console's formatter used
relative to "now".
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The input pattern and the two-digit-year window
# (80 years back, 20 years ahead of the reference date).
REQUEST_DATE_PATTERN = "d-MMM-yy"
YEARS_AHEAD = 20
DEFAULT_REFERENCE_DATE = _dt.date(2026, 1, 1)


def parse_request_date(c: str | Column,
                       reference_date: _dt.date = DEFAULT_REFERENCE_DATE) -> Column:
    """``dd-MMM-yy`` (day of 1 or 2 digits, month in any letter case)
    to DATE, NULL when unparseable.  Spark's pattern parser is already
    case-insensitive and strict (whole text, two-digit year)."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    parsed = F.try_to_date(text, REQUEST_DATE_PATTERN)
    # yy -> 20yy; move back a century when beyond the window.
    limit = F.add_months(F.lit(reference_date), 12 * YEARS_AHEAD)
    return F.add_months(parsed, F.when(parsed > limit, F.lit(-1200)).otherwise(F.lit(0)))
