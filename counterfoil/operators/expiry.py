"""Expiry of uncollected collection orders.

An incomplete collection order whose collection date is at least ``days``
(8) before the run date is cancelled: the order, its lines, collection rows
and staff links go, and the lines' quantities return to stock.  Deliveries
reference orders without cascade, so an order that also has a delivery row
cannot be deleted; it is kept and reported as blocked.

All steps are semi/anti joins on order_id -- no per-order loop; the
removed set is used by several outputs, so :func:`expire_collections`
returns it for the caller to materialise once (see ``plans.jobs``).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Tables
from .stock import restock

# Fixed value: days after the collection date an order is kept waiting.
EXPIRY_DAYS = 8


def _as_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def uncollected_collections(t: Tables) -> DataFrame:
    """(order_id, collection_date) of incomplete orders with a
    collection row (one row per collection row)."""
    return (t.orders.filter(F.col("completed") == 0).select("order_id")
            .join(t.collections.select("order_id", "collection_date"), "order_id"))


def expired_orders(t: Tables, as_of, days: int = EXPIRY_DAYS) -> DataFrame:
    """E1 rows with ``as_of >= collection_date + days`` (NULL dates
    never expire).  Written as ``collection_date <= as_of - days`` so the
    bound folds to a literal and is pushed to the collections scan."""
    return uncollected_collections(t).filter(
        F.col("collection_date") <= F.date_sub(_as_date(as_of), days))


def _hashed(order_ids: DataFrame) -> DataFrame:
    """Distinct ids as the hashed side of a join with the order lines, which
    then pass by a partition's ids; a sort-merge join would sort the lines."""
    return order_ids.select("order_id").hint("shuffle_hash")


def cascade_from_parent(child: DataFrame, removed_keys: DataFrame, key: str) -> DataFrame:
    """Child rows left after their parent keys are deleted."""
    return child.join(removed_keys.select(key), key, "left_anti")


def blocked_by_deliveries(t: Tables, order_ids: DataFrame) -> DataFrame:
    """Order ids that a delivery row stops from being deleted (Q9)."""
    return order_ids.join(t.deliveries.select("order_id"), "order_id", "left_semi")


def cascade_delete(t: Tables, removed: DataFrame) -> Tables:
    """Delete ``removed`` orders and their dependants (no restock)."""
    return t.replace(
        orders=cascade_from_parent(t.orders, removed, "order_id"),
        order_products=t.order_products.join(_hashed(removed), "order_id", "left_anti"),
        collections=cascade_from_parent(t.collections, removed, "order_id"),
        staff_orders=cascade_from_parent(t.staff_orders, removed, "order_id"))


def remove_old_orders(t: Tables, as_of, days: int = EXPIRY_DAYS) -> DataFrame:
    """The orders table after the expiry delete."""
    return expire_collections(t, as_of, days).tables.orders


def remove_products(t: Tables, product_ids: DataFrame) -> Tables:
    """E5: delete products; their order lines cascade (nothing to restock)."""
    return t.replace(inventory=cascade_from_parent(t.inventory, product_ids, "product_id"),
                     order_products=cascade_from_parent(t.order_products, product_ids, "product_id"))


def remove_staff(t: Tables, staff_ids: DataFrame) -> Tables:
    """E5: delete staff; their order links cascade."""
    return t.replace(staff=cascade_from_parent(t.staff, staff_ids, "staff_id"),
                     staff_orders=cascade_from_parent(t.staff_orders, staff_ids, "staff_id"))


@dataclass(frozen=True)
class ExpiryResult:
    tables: Tables          # tables after the run
    cancelled: DataFrame    # distinct order_id removed
    blocked: DataFrame      # distinct order_id kept because of a delivery row


ON_BLOCKED = ("skip", "abort")


def expire_collections(t: Tables, as_of, days: int = EXPIRY_DAYS,
                       materialize=None, on_blocked: str = "skip") -> ExpiryResult:
    """One expiry run (E2 + E3 + E4 + D2).

    ``materialize`` (e.g. ``lambda df: df.checkpoint()``) is applied to the
    expired and blocked id sets, which feed every output table.
    ``on_blocked``: "skip" keeps an order that has a delivery row and
    removes the others; "abort" removes nothing when any order is blocked
    (the single failing DELETE of the source)."""
    if on_blocked not in ON_BLOCKED:
        raise ValueError(f"on_blocked must be one of {ON_BLOCKED}")
    keep = materialize or (lambda df: df)
    expired = keep(expired_orders(t, as_of, days).select("order_id").distinct())
    blocked = keep(blocked_by_deliveries(t, expired))
    removed = expired.join(blocked, "order_id", "left_anti")
    if on_blocked == "abort" and blocked.limit(1).count() > 0:
        removed = removed.filter(F.lit(False))   # the whole run fails: nothing removed
    removed_lines = t.order_products.join(_hashed(removed), "order_id", "left_semi")
    after = cascade_delete(t, removed).replace(inventory=restock(t.inventory, removed_lines))
    return ExpiryResult(after, removed, blocked)
