"""The ``Tables`` bundle: the seven ledger tables as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .sources.schemas import TABLE_SCHEMAS


@dataclass(frozen=True)
class Tables:
    inventory: DataFrame
    orders: DataFrame
    order_products: DataFrame
    deliveries: DataFrame
    collections: DataFrame
    staff: DataFrame
    staff_orders: DataFrame
    version: int | None = None      # published version these tables were read at

    def replace(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def items(self):
        return [(name, getattr(self, name)) for name in TABLE_SCHEMAS]

    def register_views(self, prefix: str = "") -> None:
        """Expose every table as a temp view for SQL users."""
        for name, df in self.items():
            df.createOrReplaceTempView(prefix + name)

    @staticmethod
    def from_rows(spark: SparkSession, **rows) -> "Tables":
        """Build tables from small in-memory row lists (tests, fixtures)."""
        return Tables(**{
            name: spark.createDataFrame(rows.get(name, []), schema)
            for name, schema in TABLE_SCHEMAS.items()
        })
