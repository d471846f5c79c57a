"""Report aggregates kept up to date by deltas (R2, R5, R9, R11, R13, strict mode).

Three aggregates answer these reports:

    products (product_id)              all lines
    years    (yr, product_id)          lines of orders with a staff row
    cells    (yr, staff_id, product_id) a line for each staff row of its order

each with ``units`` (summed quantity) and ``n`` (lines).  Appended orders add
to them, cancelled orders take away, both as signed sums of their own lines:
a batch reads its new rows, the lines of the orders it cancels, and the
aggregates, never the ledger's lines.  An entry whose ``n`` falls to 0 goes, so
an aggregate is what a full pass would give, row for row.

Employees of the year are a division (who sold *every* top product of a year)
and not additive: they are worked out again, but only for the years that a
batch touched or in which a product's price changed; others keep their answer.
:func:`crossed` tells which products passed or left a threshold.

Values are price x units at the current price, as in ``operators.reports``.
Joins of a batch go by ``order_id`` and sums are partial on the map side, so
a hot product or staff member is a row a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import as_money, meets
from ..functions.names import full_name
from ..tables import Tables
from .reports import TOP_PRODUCT_MIN, YEARLY_SALES_MIN

KEYS = {"products": ["product_id"], "years": ["yr", "product_id"], "cells": ["yr", "staff_id", "product_id"]}


@dataclass(frozen=True)
class Aggregates:
    products: DataFrame
    years: DataFrame
    cells: DataFrame

    def items(self):
        return [(name, getattr(self, name)) for name in KEYS]


def _sums(lines: DataFrame, name: str, sign: int = 1) -> DataFrame:
    return lines.groupBy(*KEYS[name]).agg((F.lit(sign) * F.sum("quantity")).cast("bigint").alias("units"),
                                          (F.lit(sign) * F.count(F.lit(1))).alias("n"))


def aggregates(orders: DataFrame, order_products: DataFrame, staff_orders: DataFrame, sign: int = 1) -> Aggregates:
    """The three aggregates of some whole orders with their lines and staff rows."""
    dated = orders.select("order_id", F.year("order_placed").alias("yr"))
    lines = order_products.select("order_id", "product_id", "quantity")
    links = staff_orders.select("staff_id", "order_id")
    linked = lines.join(dated, "order_id").join(links.select("order_id"), "order_id", "left_semi")
    return Aggregates(_sums(lines, "products", sign), _sums(linked, "years", sign),
                      _sums(lines.join(dated, "order_id").join(links, "order_id"), "cells", sign))


def ledger_aggregates(t: Tables) -> Aggregates:
    return aggregates(t.orders, t.order_products, t.staff_orders)


def delta(added: dict[str, DataFrame] | None = None, ledger: Tables | None = None,
          cancelled: DataFrame | None = None) -> Aggregates:
    """Signed aggregates of a batch: ``added`` (orders, order_products and
    staff_orders of new orders, e.g. ``Placement.new_rows``) and the orders of
    ``ledger`` whose ``order_id`` is in ``cancelled``."""
    parts = []
    if added is not None:
        parts.append(aggregates(added["orders"], added["order_products"], added["staff_orders"]))
    if cancelled is not None:
        gone = {n: getattr(ledger, n).join(cancelled.select("order_id").distinct(), "order_id", "left_semi")
                for n in ("orders", "order_products", "staff_orders")}
        parts.append(aggregates(gone["orders"], gone["order_products"], gone["staff_orders"], -1))
    if not parts:
        raise ValueError("a batch adds or cancels orders")
    return reduce(_add, parts)


def _add(a: Aggregates, b: Aggregates) -> Aggregates:
    return Aggregates(**{name: df.unionByName(getattr(b, name)).groupBy(*KEYS[name]).agg(
        F.sum("units").alias("units"), F.sum("n").alias("n")) for name, df in a.items()})


def merged(state: Aggregates, change: Aggregates, materialize=None) -> Aggregates:
    """The state after a batch.  ``materialize`` (e.g. ``lambda df:
    df.checkpoint()``) keeps the plan one batch deep."""
    keep = materialize or (lambda df: df)
    return Aggregates(**{name: keep(df.filter(F.col("n") != 0)) for name, df in _add(state, change).items()})


def product_revenue(a: Aggregates, inventory: DataFrame) -> DataFrame:
    """R2 from the kept sums (unsold products at 0)."""
    value = F.coalesce(F.col("price") * F.col("units"), F.lit(0))
    return (inventory.join(a.products, "product_id", "left")
            .select("product_id", "product_desc", as_money(value).alias("total_value"))
            .orderBy(F.desc("total_value"), "product_id"))


def top_products(a: Aggregates, inventory: DataFrame, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """R5 from the kept sums."""
    return product_revenue(a, inventory).filter(meets("total_value", min_value, inclusive)).select("product_id", "total_value")


def crossed(before: Aggregates, change: Aggregates, inventory: DataFrame, min_value=TOP_PRODUCT_MIN,
            inclusive: bool = False) -> DataFrame:
    """(product_id, entered): products that a batch takes over the R5
    threshold (true) or below it again (false); only products of the batch are
    looked up."""
    moved = change.products.select("product_id", F.col("units").alias("_moved"))
    both = (moved.join(before.products.select("product_id", "units"), "product_id", "left")
            .join(inventory.select("product_id", "price"), "product_id"))
    was = F.coalesce(F.col("units"), F.lit(0))
    both = both.select("product_id", (F.col("price") * was).alias("_was"), (F.col("price") * (was + F.col("_moved"))).alias("_is"))
    over = [F.coalesce(meets(c, min_value, inclusive), F.lit(False)) for c in ("_was", "_is")]
    return both.select("product_id", over[0].alias("_over"), over[1].alias("entered")).filter(
        F.col("_over") != F.col("entered")).select("product_id", "entered")


def yearly_top_products(a: Aggregates, inventory: DataFrame, min_value=TOP_PRODUCT_MIN, inclusive: bool = False) -> DataFrame:
    """R9 from the kept sums."""
    return (a.years.join(inventory.select("product_id", "price"), "product_id")
            .select("yr", "product_id", as_money(F.col("price") * F.col("units")).alias("total_value"))
            .filter(meets("total_value", min_value, inclusive)))


def yearly_staff_sales(a: Aggregates, inventory: DataFrame, min_total=YEARLY_SALES_MIN, inclusive: bool = True) -> DataFrame:
    """R11 from the kept sums."""
    return (a.cells.join(inventory.select("product_id", "price"), "product_id")
            .groupBy("staff_id", "yr").agg(F.sum(F.col("price") * F.col("units")).alias("total_sales"))
            .filter(meets("total_sales", min_total, inclusive))
            .select("staff_id", "yr", as_money("total_sales").alias("total_sales"))
            .orderBy(F.desc("total_sales"), "staff_id", "yr"))


def winners(a: Aggregates, inventory: DataFrame, product_min=TOP_PRODUCT_MIN, product_inclusive: bool = False,
            staff_min=YEARLY_SALES_MIN, staff_inclusive: bool = True) -> DataFrame:
    """(yr, staff_id) of R13, every year of ``a``."""
    prices = inventory.select("product_id", "price")
    top = yearly_top_products(a, inventory, product_min, product_inclusive).select(
        "yr", "product_id", F.count(F.lit(1)).over(Window.partitionBy("yr")).alias("needed"))
    return (a.cells.join(prices, "product_id").join(top, ["yr", "product_id"], "left")
            .groupBy("yr", "staff_id").agg(F.sum(F.col("price") * F.col("units")).alias("_sales"),
                                           F.count("needed").alias("_n"), F.max("needed").alias("_needed"))
            .filter(meets("_sales", staff_min, staff_inclusive) & (F.col("_n") == F.col("_needed")))
            .select("yr", "staff_id"))


def changed_years(change: Aggregates, state: Aggregates | None = None, repriced: DataFrame | None = None) -> DataFrame:
    """Years that a batch touches: those of its lines and, where prices of
    ``repriced`` (product_id) changed, those in which such a product was sold."""
    years = change.cells.select("yr").unionByName(change.years.select("yr"))
    if repriced is not None:
        years = years.unionByName(state.years.join(repriced.select("product_id"), "product_id", "left_semi").select("yr"))
    return years.distinct()


def updated_winners(before: DataFrame, state: Aggregates, years: DataFrame, inventory: DataFrame, **limits) -> DataFrame:
    """R13's (yr, staff_id) after a batch: ``years`` are divided again, the
    others keep what ``before`` says.  ``state`` is the state after the batch."""
    again = Aggregates(state.products, *[df.join(years, "yr", "left_semi") for df in (state.years, state.cells)])
    return before.join(years, "yr", "left_anti").unionByName(winners(again, inventory, **limits))


def employees_of_the_year(won: DataFrame, staff: DataFrame) -> DataFrame:
    """R13 with names."""
    return (won.join(staff, "staff_id").select("yr", "staff_id", full_name().alias("full_name"))
            .orderBy("yr", "full_name", "staff_id"))
