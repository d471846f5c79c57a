"""A stored layout of the ledger for the big joins and the expiry run.

Orders, their lines and staff rows are bucketed and sorted by ``order_id``, so
the three-way join of the staff reports needs no exchange: each task merges
the same bucket of the three tables.  Lines, links, orders and collections are
also partitioned by the month in which the order is due for collection
(``due_month``, 'none' without a collection row).  An expiry run with a cut-off
date reads the months up to it (a static partition filter); the expired ids
are written once, and of the dependants only the months that hold one are read
(pruning at run time, by a list as long as the calendar at most).

An order of several collection rows is due at the earliest.  The number of
buckets is a parameter: about 128 MB of lines a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expiry import EXPIRY_DAYS, _as_date
from ..session import ensure_checkpoint_dir
from ..sources.schemas import TABLE_SCHEMAS
from ..tables import Tables

BY_ORDER = ("orders", "order_products", "staff_orders", "collections")   # bucketed, by due month
NO_MONTH = "none"


def _month(date) -> F.Column:
    return F.date_format(date, "yyyy-MM")


@dataclass(frozen=True)
class Layout:
    """The tables ``<name>_<table>`` of the session's catalog."""
    spark: SparkSession
    name: str

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def tables(self) -> Tables:
        return Tables(**{n: self.table(n).select(*s.fieldNames()) for n, s in TABLE_SCHEMAS.items()})

    def expired_orders(self, as_of, days: int = EXPIRY_DAYS) -> DataFrame:
        """E2 as (order_id, due_month), each order once."""
        last = F.date_sub(_as_date(as_of), days)
        due = self.table("collections").filter((F.col("due_month") <= _month(last)) & (F.col("due_month") != NO_MONTH)
                                               & (F.col("collection_date") <= last))
        waiting = self.table("orders").filter((F.col("completed") == 0) & (F.col("due_month") <= _month(last))
                                              & (F.col("due_month") != NO_MONTH))
        return waiting.select("order_id", "due_month").join(
            due.select("order_id", "due_month"), ["order_id", "due_month"], "left_semi")

    def removed_orders(self, as_of, days: int = EXPIRY_DAYS) -> DataFrame:
        """The expired orders that no delivery row holds back."""
        return self.expired_orders(as_of, days).join(self.table("deliveries").select("order_id"), "order_id", "left_anti")

    def dependants(self, table: str, removed: DataFrame) -> DataFrame:
        """Rows of a table whose order is in ``removed`` (order_id, due_month;
        stored), reading only the months these are due in."""
        months = [r[0] for r in removed.select("due_month").distinct().collect()]    # a row a month of the calendar
        return (self.table(table).filter(F.col("due_month").isin(months))
                .join(removed.select("order_id", "due_month"), ["order_id", "due_month"], "left_semi")
                .select(*TABLE_SCHEMAS[table].fieldNames()))

    def returned_stock(self, as_of, days: int = EXPIRY_DAYS) -> DataFrame:
        """(product_id, quantity) that an expiry run puts back on the shelf."""
        ensure_checkpoint_dir(self.spark)
        removed = self.removed_orders(as_of, days).checkpoint(eager=True)
        lines = self.dependants("order_products", removed)
        return lines.groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("quantity"))

    def drop(self) -> None:
        for n in TABLE_SCHEMAS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{n}")


def store(t: Tables, name: str, path: str, buckets: int) -> Layout:
    """Write ``t`` in this layout under ``path`` (one folder a table)."""
    spark = t.orders.sparkSession
    due = t.collections.groupBy("order_id").agg(F.min("collection_date").alias("_due"))
    for n, df in t.items():
        where = f"{path.rstrip('/')}/{n}"
        if n not in BY_ORDER:
            df.write.option("path", where).saveAsTable(f"{name}_{n}")
            continue
        dated = df.join(due, "order_id", "left").withColumn("due_month", F.coalesce(_month("_due"), F.lit(NO_MONTH)))
        (dated.select(*TABLE_SCHEMAS[n].fieldNames(), "due_month").repartition(buckets, "order_id")
         .write.partitionBy("due_month").bucketBy(buckets, "order_id").sortBy("order_id")
         .option("path", where).saveAsTable(f"{name}_{n}"))
    return Layout(spark, name)
