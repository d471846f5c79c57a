"""Report rows as the console printed them.

Staff reports (name, money) use two 30-wide left-aligned fields, product
reports (id, description, money) three; each field but the last ends with a
comma, fields are separated by one space, and money is shown in whole
pounds with pence dropped (truncated toward zero).  The result is a
DataFrame of text lines, written like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field layouts, titles and the divider of the console tables.
TWO_FIELDS = "%-30s%-1s%-30s"
THREE_FIELDS = "%-30s%-1s%-30s%-1s%-30s"
STAFF_TITLES = ("EmployeeName", "TotalValueSold")
PRODUCT_TITLES = ("Product ID", "ProductDesc", "TotalValueSold")
DIVIDER = "-" * 30
CURRENCY = "£"


def _pounds(c: str):
    return F.concat(F.lit(CURRENCY), F.col(c).cast("long").cast("string"))


def report_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per report row (product revenue or staff sales)."""
    cols = set(df.columns)
    if {"product_id", "product_desc", "total_value"} <= cols:
        line = F.format_string(THREE_FIELDS,
                               F.concat(F.col("product_id").cast("string"), F.lit(",")), F.lit(" "),
                               F.concat(F.col("product_desc"), F.lit(",")), F.lit(" "),
                               _pounds("total_value"))
    elif {"full_name", "lifetime_sales"} <= cols:
        line = F.format_string(TWO_FIELDS, F.concat(F.col("full_name"), F.lit(",")), F.lit(" "),
                               _pounds("lifetime_sales"))
    else:
        raise ValueError(f"no display layout for columns {df.columns}")
    return df.select(line.alias("line"))


def report_header(kind: str) -> list[str]:
    """Title and divider lines ('staff' or 'product')."""
    if kind == "staff":
        return [TWO_FIELDS % (STAFF_TITLES[0], " ", STAFF_TITLES[1]),
                TWO_FIELDS % (DIVIDER, " ", DIVIDER)]
    return [THREE_FIELDS % (PRODUCT_TITLES[0], " ", PRODUCT_TITLES[1], " ", PRODUCT_TITLES[2]),
            THREE_FIELDS % (DIVIDER, " ", DIVIDER, " ", DIVIDER)]
