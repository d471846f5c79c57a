"""Sales reports.

Semantics follow the reference's views; where its code and its
documentation disagree, ``mode`` picks the reading:

* ``"strict"`` (default, documented meaning): an order's value is counted
  once however many staff rows it has, and credited in full to each of
  them; "sold in the year" means an order placed in that year; the yearly
  sales test is on (staff, year).
* ``"compat"`` (the views as written): an order with k staff rows counts k
  times in its total (fan-out of the sale-values join); a staff member's
  sale of a product in *any* year counts; the yearly sales test is passed
  by a staff member who reached it in some year when anybody reached it in
  this year.

Plan shape: the fact table (order lines) is aggregated as early as the
semantics allow -- by product, by (year, product), by (staff, product) --
and prices and names are joined to the aggregates, not to the lines.  When
an order's value needs per-line prices, lines join inventory first, then the
orders they belong to, and the total is summed on the order key the last
join already partitioned by.  Join strategies are left to adaptive
execution, which broadcasts a side only after measuring it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import as_money, line_value, meets
from ..functions.names import full_name
from ..tables import Tables

MODES = ("strict", "compat")

# The reference's report thresholds and their comparisons.
TOP_PRODUCT_MIN = 20000          # product value must be strictly above
LIFETIME_SALES_MIN = 50000       # staff lifetime sales at or above
YEARLY_SALES_MIN = 30000         # staff sales in a year at or above


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def _prices(t: Tables) -> DataFrame:
    return t.inventory.select("product_id", "price")


def _linked_orders(t: Tables, mode: str) -> DataFrame:
    """Orders with at least one staff row: (order_id, yr, w).

    ``w`` is the weight of each of the order's lines in a total: 1 in strict
    mode, the number k of the order's staff rows in compat mode.
    """
    _check_mode(mode)
    k = t.staff_orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("k"))
    linked = (t.orders.select("order_id", F.year("order_placed").alias("yr"))
              .join(k, "order_id"))
    w = F.lit(1).cast("long") if mode == "strict" else F.col("k")
    return linked.select("order_id", "yr", w.alias("w"))


# ---------------------------------------------------------------- R1 / R3

def sale_values(t: Tables) -> DataFrame:
    """One row per order line and staff row of its order, valued at the
    current price (the reference view, fan-out included)."""
    return (t.order_products
            .join(_prices(t), "product_id")
            .join(t.orders.select("order_id", "order_placed"), "order_id")
            .join(t.staff_orders, "order_id")
            .select("staff_id", "order_placed", "product_id", "order_id",
                    as_money(line_value()).alias("sale_value")))


def _order_totals(t: Tables, mode: str) -> DataFrame:
    """(order_id, yr, order_total) for orders with a staff row."""
    linked = _linked_orders(t, mode)
    return (t.order_products
            .join(_prices(t), "product_id")
            .join(linked, "order_id")
            .groupBy("order_id", "yr")
            .agg(F.sum(line_value() * F.col("w")).alias("order_total")))


def order_totals(t: Tables, mode: str = "strict") -> DataFrame:
    """Value of each order that has a staff row."""
    return _order_totals(t, mode).select("order_id", as_money("order_total").alias("order_total"))


# ---------------------------------------------------------------- R2 / R5

def product_revenue(t: Tables) -> DataFrame:
    """R2: every product with price x units sold, unsold products at 0,
    highest first.  Counts every line, with or without staff (Q20)."""
    units = t.order_products.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    return (t.inventory.join(units, "product_id", "left")
            .select("product_id", "product_desc",
                    as_money(F.coalesce(F.col("price") * F.col("units"), F.lit(0)))
                    .alias("total_value"))
            .orderBy(F.desc("total_value"), "product_id"))


def top_products(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """Products whose all-time value passes ``min_value``."""
    return (product_revenue(t).filter(meets("total_value", min_value, inclusive))
            .select("product_id", "total_value"))


# ---------------------------------------------------------------- R4

def staff_lifetime_sales(t: Tables, min_total=LIFETIME_SALES_MIN, inclusive: bool = True,
                         mode: str = "strict") -> DataFrame:
    """Staff whose summed order totals pass ``min_total``, highest first."""
    totals = _order_totals(t, mode)
    per_staff = (t.staff_orders.join(totals, "order_id")
                 .groupBy("staff_id").agg(F.sum("order_total").alias("lifetime_sales"))
                 .filter(meets("lifetime_sales", min_total, inclusive)))
    return (per_staff.join(t.staff, "staff_id")
            .select(full_name().alias("full_name"), "staff_id",
                    as_money("lifetime_sales").alias("lifetime_sales"))
            .orderBy(F.desc("lifetime_sales"), "staff_id"))


# ---------------------------------------------------------------- R6-R8

def top_product_sellers(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """Per staff member and top product: units sold and their value.

    A line is credited to every staff row of its order (as the reference
    does in both modes).  Units are summed first; value = price x units is
    exact because the price is one per product.
    """
    top = top_products(t, min_value, inclusive).select("product_id")
    units = (t.order_products.join(top, "product_id", "left_semi")
             .join(t.staff_orders, "order_id")
             .groupBy("staff_id", "product_id")
             .agg(F.sum("quantity").alias("units_sold")))
    return (units.join(t.staff, "staff_id").join(_prices(t), "product_id")
            .select("staff_id", "fname", "lname", "product_id", "units_sold",
                    as_money(F.col("price") * F.col("units_sold")).alias("value_sold")))


def staff_by_top_value(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """Staff ranked by the value of top products they sold."""
    return (top_product_sellers(t, min_value, inclusive)
            .groupBy("staff_id").agg(as_money(F.sum("value_sold")).alias("total_value"))
            .orderBy(F.desc("total_value"), "staff_id"))


def staff_product_units(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """R8, long form: (staff, product, units) cells of the crosstab plus the
    staff member's ranking value, a window sum over the aggregated cells."""
    per_staff = Window.partitionBy("staff_id")
    return (top_product_sellers(t, min_value, inclusive)
            .withColumn("total_value", as_money(F.sum("value_sold").over(per_staff)))
            .select("staff_id", full_name().alias("full_name"), "product_id",
                    "units_sold", "total_value")
            .orderBy(F.desc("total_value"), "staff_id", "product_id"))


def staff_product_crosstab(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """One row per seller of a top product, ranked by value, with the
    crosstab row as ``cells``: an array of (product_id, units_sold) by
    ascending product; a product that is not there has 0 units.

    The schema does not depend on the data, and an array holds one staff
    member's top products only, so any number of products fits.
    """
    return (top_product_sellers(t, min_value, inclusive)
            .groupBy("staff_id", "fname", "lname")
            .agg(as_money(F.sum("value_sold")).alias("total_value"),
                 F.sort_array(F.collect_list(F.struct("product_id", "units_sold"))).alias("cells"))
            .select(full_name().alias("full_name"), "staff_id", "total_value", "cells")
            .orderBy(F.desc("total_value"), "staff_id"))


# ---------------------------------------------------------------- R9-R13

def yearly_top_products(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False,
                        mode: str = "strict") -> DataFrame:
    """(yr, product_id, total_value) with the year's value passing
    ``min_value``; only lines of orders with a staff row count (Q20)."""
    units = (t.order_products.join(_linked_orders(t, mode), "order_id")
             .groupBy("yr", "product_id")
             .agg(F.sum(F.col("quantity") * F.col("w")).alias("units")))
    return (units.join(_prices(t), "product_id")
            .select("yr", "product_id", as_money(F.col("price") * F.col("units")).alias("total_value"))
            .filter(meets("total_value", min_value, inclusive)))


def staff_top_products(t: Tables, min_value=TOP_PRODUCT_MIN, inclusive: bool = False,
                       mode: str = "strict") -> DataFrame:
    """Distinct (yr, staff_id, product_id) where the staff member sold a
    product of that year's R9 list: in that year (strict) or ever (compat)."""
    r9 = yearly_top_products(t, min_value, inclusive, mode).select("yr", "product_id")
    candidates = t.order_products.select("order_id", "product_id").join(
        r9.select("product_id").distinct(), "product_id", "left_semi")
    if mode == "strict":
        sold = (candidates.join(t.orders.select("order_id", F.year("order_placed").alias("yr")), "order_id")
                .join(t.staff_orders, "order_id")
                .select("yr", "staff_id", "product_id").distinct())
        return sold.join(r9, ["yr", "product_id"], "left_semi")
    ever = candidates.join(t.staff_orders, "order_id").select("staff_id", "product_id").distinct()
    return ever.join(r9, "product_id").select("yr", "staff_id", "product_id")


def yearly_staff_sales(t: Tables, min_total=YEARLY_SALES_MIN, inclusive: bool = True,
                       mode: str = "strict") -> DataFrame:
    """(staff_id, yr, total_sales) whose summed order totals of the
    year pass ``min_total``, highest first."""
    return (t.staff_orders.join(_order_totals(t, mode), "order_id")
            .groupBy("staff_id", "yr").agg(F.sum("order_total").alias("total_sales"))
            .filter(meets("total_sales", min_total, inclusive))
            .select("staff_id", "yr", as_money("total_sales").alias("total_sales"))
            .orderBy(F.desc("total_sales"), "staff_id", "yr"))


def _coverage(t: Tables, product_min, product_inclusive, staff_min, staff_inclusive) -> DataFrame:
    """Strict R12 with the year's number of top products: (staff_id, yr,
    n_products, needed) for staff passing R11.

    One aggregate of lines by (yr, staff, product) gives both the products
    sold (R10) and the year's sales (R11), so with R9 the line table is read
    twice and no wide decimals are computed on it.
    """
    sold = (t.order_products
            .join(t.orders.select("order_id", F.year("order_placed").alias("yr")), "order_id")
            .join(t.staff_orders, "order_id")
            .groupBy("yr", "staff_id", "product_id").agg(F.sum("quantity").alias("units")))
    top = (yearly_top_products(t, product_min, product_inclusive, "strict")
           .select("yr", "product_id", F.count(F.lit(1)).over(Window.partitionBy("yr")).alias("needed")))
    return (sold.join(_prices(t), "product_id").join(top, ["yr", "product_id"], "left")
            .groupBy("staff_id", "yr")
            .agg(F.sum(F.col("price") * F.col("units")).alias("total_sales"),
                 F.count("needed").alias("n_products"), F.max("needed").alias("needed"))
            .filter(meets("total_sales", staff_min, staff_inclusive) & (F.col("n_products") > 0)))


def staff_yearly_coverage(t: Tables, product_min=TOP_PRODUCT_MIN, product_inclusive: bool = False,
                          staff_min=YEARLY_SALES_MIN, staff_inclusive: bool = True,
                          mode: str = "strict") -> DataFrame:
    """(full_name, staff_id, yr, n_products): how many of the year's
    top products the staff member sold, for staff passing R11."""
    _check_mode(mode)
    if mode == "strict":
        kept = _coverage(t, product_min, product_inclusive, staff_min, staff_inclusive)
    else:
        counts = (staff_top_products(t, product_min, product_inclusive, mode)
                  .groupBy("staff_id", "yr").agg(F.count("product_id").alias("n_products")))
        passed = yearly_staff_sales(t, staff_min, staff_inclusive, mode)
        kept = (counts.join(passed.select("staff_id").distinct(), "staff_id", "left_semi")
                .join(passed.select("yr").distinct(), "yr", "left_semi"))
    return (kept.join(t.staff, "staff_id")
            .select(full_name().alias("full_name"), "staff_id", "yr", "n_products"))


def employees_of_the_year(t: Tables, year: int | None = None,
                          product_min=TOP_PRODUCT_MIN, product_inclusive: bool = False,
                          staff_min=YEARLY_SALES_MIN, staff_inclusive: bool = True,
                          mode: str = "strict") -> DataFrame:
    """Staff who sold every top product of the year (relational
    division by counting) and passed the yearly sales test.

    ``year=None`` answers every year in one pass.  A year without top
    products has no winner (Q21).  In strict mode every input is per-year,
    so a given year is applied as a date range on the orders first.
    """
    _check_mode(mode)
    if mode == "strict":
        if year is not None:
            start = F.make_date(F.lit(year), F.lit(1), F.lit(1))
            t = t.replace(orders=t.orders.filter(
                (F.col("order_placed") >= start) & (F.col("order_placed") < F.add_months(start, 12))))
        winners = (_coverage(t, product_min, product_inclusive, staff_min, staff_inclusive)
                   .filter(F.col("n_products") == F.col("needed"))
                   .join(t.staff, "staff_id")
                   .select("yr", "staff_id", full_name().alias("full_name")))
    else:
        needed = (yearly_top_products(t, product_min, product_inclusive, mode)
                  .groupBy("yr").agg(F.count(F.lit(1)).alias("n_products")))
        cover = staff_yearly_coverage(t, product_min, product_inclusive, staff_min, staff_inclusive, mode)
        winners = cover.join(needed, ["yr", "n_products"]).select("yr", "staff_id", "full_name")
        if year is not None:
            winners = winners.filter(F.col("yr") == year)
    return winners.orderBy("yr", "full_name", "staff_id")
