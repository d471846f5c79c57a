"""Stock ledger.

Stock changes are set-based: quantities are summed per product (map-side
partial aggregation, so a hot product costs one row per task) and applied
with one left join to inventory.  NULL stock means untracked: it stays NULL
whatever is added or taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import INVENTORY


def _apply(inventory: DataFrame, lines: DataFrame, sign: int) -> DataFrame:
    moved = lines.groupBy("product_id").agg(F.sum("quantity").alias("_moved"))
    return (inventory.join(moved, "product_id", "left")
            .select(*[c for c in INVENTORY.fieldNames() if c != "stock"],
                    (F.col("stock") + F.lit(sign) * F.coalesce(F.col("_moved"), F.lit(0)))
                    .alias("stock")))


def reduce_stock(inventory: DataFrame, lines: DataFrame) -> DataFrame:
    """Subtract sold quantities (lines: product_id, quantity)."""
    return _apply(inventory, lines, -1)


def restock(inventory: DataFrame, removed_lines: DataFrame) -> DataFrame:
    """Add back the quantities of deleted order lines."""
    return _apply(inventory, removed_lines, +1)


def stock_levels(inventory: DataFrame, requested: DataFrame) -> DataFrame:
    """D3: stock of requested products, request order and repeats kept.

    ``requested``: (seq, pos, product_id).  A missing product or untracked
    stock gives NULL (the console printed 0 for both).
    """
    return (requested.join(inventory.select("product_id", "stock"), "product_id", "left")
            .select("seq", "pos", "product_id", "stock")
            .orderBy("seq", "pos"))


def sufficient_stock(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per line, ``stock >= quantity`` against current stock without
    consuming it; NULL when the product is missing or its stock untracked."""
    return (lines.join(inventory.select("product_id", "stock"), "product_id", "left")
            .withColumn("sufficient", F.col("stock") >= F.col("quantity")))


def fulfilment_type(orders: DataFrame, collections: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The order type implied by the dependants of each order.

    Orders written by the reference all carry 'InStore' (its insert passes
    the literal); a collection row means 'Collection', a delivery row
    'Delivery' (a delivery row wins if both exist), none 'InStore'.
    """
    kinds = (collections.select("order_id", F.lit(1).alias("c"), F.lit(0).alias("d"))
             .unionByName(deliveries.select("order_id", F.lit(0).alias("c"), F.lit(1).alias("d")))
             .groupBy("order_id").agg(F.max("c").alias("c"), F.max("d").alias("d")))
    return (orders.join(kinds, "order_id", "left")
            .select("order_id", F.col("order_type").alias("stored_type"),
                    F.when(F.col("d") == 1, "Delivery").when(F.col("c") == 1, "Collection")
                     .otherwise("InStore").alias("order_type")))
