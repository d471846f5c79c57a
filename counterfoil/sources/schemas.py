"""Explicit schemas of the ledger tables and of order requests.

Schemas are declared, never inferred.  Keys are longs, quantities ints,
prices exact ``DECIMAL(8,2)``; every money aggregate is widened to
``MONEY`` (``DECIMAL(38,2)``) so sums never lose pence.
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(8, 2)
MONEY = T.DecimalType(38, 2)

INVENTORY = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_desc", T.StringType(), False),
    T.StructField("price", PRICE, False),
    T.StructField("stock", T.LongType(), True),   # NULL = untracked stock
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("order_type", T.StringType(), False),
    T.StructField("completed", T.IntegerType(), False),
    T.StructField("order_placed", T.DateType(), True),
])

ORDER_PRODUCTS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("quantity", T.IntegerType(), False),
])

DELIVERIES = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("fname", T.StringType(), False),
    T.StructField("lname", T.StringType(), False),
    T.StructField("house", T.StringType(), False),
    T.StructField("street", T.StringType(), False),
    T.StructField("city", T.StringType(), False),
    T.StructField("delivery_date", T.DateType(), True),
])

COLLECTIONS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("fname", T.StringType(), False),
    T.StructField("lname", T.StringType(), False),
    T.StructField("collection_date", T.DateType(), True),
])

STAFF = T.StructType([
    T.StructField("staff_id", T.LongType(), False),
    T.StructField("fname", T.StringType(), False),
    T.StructField("lname", T.StringType(), False),
])

STAFF_ORDERS = T.StructType([
    T.StructField("staff_id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), False),
])

# One order request as typed at the till: parallel product / quantity
# arrays, dates as text (dd-MMM-yy), optional customer and address.
REQUESTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("order_type", T.StringType(), True),
    T.StructField("products", T.ArrayType(T.LongType()), True),
    T.StructField("quantities", T.ArrayType(T.IntegerType()), True),
    T.StructField("sale_date", T.StringType(), True),
    T.StructField("due_date", T.StringType(), True),
    T.StructField("fname", T.StringType(), True),
    T.StructField("lname", T.StringType(), True),
    T.StructField("house", T.StringType(), True),
    T.StructField("street", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("staff_id", T.LongType(), True),
])

# The same request as text (form input, csv, untyped json): see
# ``intake.coerce_requests``.
RAW_REQUESTS = T.StructType([T.StructField(f.name, T.StringType(), True) for f in REQUESTS.fields])

TABLE_SCHEMAS = {
    "inventory": INVENTORY,
    "orders": ORDERS,
    "order_products": ORDER_PRODUCTS,
    "deliveries": DELIVERIES,
    "collections": COLLECTIONS,
    "staff": STAFF,
    "staff_orders": STAFF_ORDERS,
}

# Fixed values of the data model (must equal the reference's):
# order types, and the longest text a VARCHAR(30) column holds.
ORDER_TYPES = ("InStore", "Collection", "Delivery")
MAX_TEXT = 30
