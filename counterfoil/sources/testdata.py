"""Binding of the driver's TPC-H-like tables to the ledger model.

Every table is a lazy projection/join of the parquet scans, so filters and
column pruning reach the files.  The same rules are written as DuckDB SQL in
``counterfoil.plans.oracle`` for the correctness oracle; keep them in step.

Rules (the data has no stock, no order types and no staff, so they are
derived):

* inventory: part; price = p_retailprice as DECIMAL(8,2); stock = p_size * 20
* orders: type from the first character of o_orderpriority (1, 2 InStore;
  3, 4 Collection; 5 Delivery); completed = 1 for InStore or status 'F'
* order_products: lineitem (order, part, quantity as INT)
* collections / deliveries: Collection / Delivery orders with the
  customer's name split at '#'; due date = order date + 1 + order_id % 14;
  deliveries add house = customer key, street = segment, city = nation name
* staff: one of nation (default), region or customer; staff_orders links an
  order to its customer's nation / region / the customer itself

Added, so that every rule of the operators meets rows that show it:

* stock is NULL (untracked) for parts divisible by 97
* parts divisible by 101 have a never sold "spare" product beside them
* orders divisible by 7 have a second staff row, the next staff member
* Collection orders divisible by 11 have a delivery row as well
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import split_name
from ..sources.schemas import PRICE
from ..tables import Tables

STAFF_BINDINGS = ("nation", "region", "customer")

# Fixed values of the binding: priority digit -> order type, stock factor,
# due-date spread in days.
PRIORITY_TYPES = {"1": "InStore", "2": "InStore", "3": "Collection",
                  "4": "Collection", "5": "Delivery"}
STOCK_PER_SIZE = 20
DUE_SPREAD_DAYS = 14
UNTRACKED_EVERY, SPARE_EVERY, HELPED_EVERY, ALSO_DELIVERED_EVERY = 97, 101, 7, 11
SPARE_ID = 1_000_000_000
N_NATIONS, N_REGIONS = 25, 5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_type(priority: Column) -> Column:
    digit = F.substring(priority, 1, 1)
    expr = None
    for d, kind in PRIORITY_TYPES.items():
        expr = (F.when(digit == d, kind) if expr is None
                else expr.when(digit == d, kind))
    return expr


def _due_date(order_date: Column, order_key: Column) -> Column:
    return F.date_add(order_date, (F.lit(1) + order_key % DUE_SPREAD_DAYS).cast("int"))


def bind_tables(spark: SparkSession, sf_dir: str, staff_by: str = "nation") -> Tables:
    if staff_by not in STAFF_BINDINGS:
        raise ValueError(f"staff_by must be one of {STAFF_BINDINGS}")
    part = _read(spark, sf_dir, "part")
    src_orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")

    stock = F.col("p_size").cast("long") * STOCK_PER_SIZE
    key, price = F.col("p_partkey").cast("long"), F.col("p_retailprice").cast(PRICE).alias("price")
    inventory = part.select(
        key.alias("product_id"), F.col("p_name").alias("product_desc"), price,
        F.when(key % UNTRACKED_EVERY != 0, stock).alias("stock")
    ).unionByName(part.filter(key % SPARE_EVERY == 0).select(
        (key + SPARE_ID).alias("product_id"), F.concat(F.lit("spare "), "p_name").alias("product_desc"),
        price, stock.alias("stock")))

    typed = src_orders.select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("cust_id"),
        _order_type(F.col("o_orderpriority")).alias("order_type"),
        F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("order_placed"))

    orders = typed.select(
        "order_id", "order_type",
        F.when((F.col("order_type") == "InStore") | (F.col("status") == "F"), 1)
         .otherwise(0).alias("completed"),
        "order_placed")

    order_products = lineitem.select(
        F.col("l_orderkey").cast("long").alias("order_id"),
        F.col("l_partkey").cast("long").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"))

    cust = customer.select(
        F.col("c_custkey").cast("long").alias("cust_id"),
        *[c.alias(n) for c, n in zip(split_name("c_name", "#"), ("fname", "lname"))],
        F.col("c_nationkey").cast("long").alias("nation_id"),
        F.col("c_mktsegment").alias("segment"))

    due = _due_date(F.col("order_placed"), F.col("order_id"))
    collections = (typed.filter(F.col("order_type") == "Collection")
                   .join(cust, "cust_id")
                   .select("order_id", "fname", "lname", due.alias("collection_date")))
    delivered = (F.col("order_type") == "Delivery") | (
        (F.col("order_type") == "Collection") & (F.col("order_id") % ALSO_DELIVERED_EVERY == 0))
    deliveries = (typed.filter(delivered)
                  .join(cust, "cust_id")
                  .join(nation.select(F.col("n_nationkey").cast("long").alias("nation_id"),
                                      F.col("n_name").alias("city")), "nation_id")
                  .select("order_id", "fname", "lname",
                          F.col("cust_id").cast("string").alias("house"),
                          F.col("segment").alias("street"), "city",
                          due.alias("delivery_date")))

    staff, staff_orders = _bind_staff(staff_by, typed, cust, nation, region)
    return Tables(inventory=inventory, orders=orders, order_products=order_products,
                  deliveries=deliveries, collections=collections, staff=staff,
                  staff_orders=staff_orders)


def _bind_staff(staff_by, typed, cust, nation, region):
    links = typed.select("order_id", "cust_id").join(cust.select("cust_id", "nation_id"), "cust_id")
    if staff_by == "nation":
        fn, ln = split_name("n_name", "_")
        staff = nation.select(F.col("n_nationkey").cast("long").alias("staff_id"),
                              fn.alias("fname"), ln.alias("lname"))
        staff_orders = links.select(F.col("nation_id").alias("staff_id"), "order_id")
    elif staff_by == "region":
        fn, ln = split_name("r_name", " ")
        staff = region.select(F.col("r_regionkey").cast("long").alias("staff_id"),
                              fn.alias("fname"), ln.alias("lname"))
        staff_orders = (links.join(nation.select(F.col("n_nationkey").cast("long").alias("nation_id"),
                                                 F.col("n_regionkey").cast("long").alias("staff_id")),
                                   "nation_id")
                        .select("staff_id", "order_id"))
    else:
        staff = cust.select(F.col("cust_id").alias("staff_id"), "fname", "lname")
        staff_orders = links.select(F.col("cust_id").alias("staff_id"), "order_id")
    following = F.col("staff_id") + 1
    count = {"nation": N_NATIONS, "region": N_REGIONS}.get(staff_by)
    helpers = staff_orders.filter(F.col("order_id") % HELPED_EVERY == 0).select(
        (following % count if count else following).alias("staff_id"), "order_id")
    if not count:
        helpers = helpers.join(staff.select("staff_id"), "staff_id", "left_semi")
    return staff, staff_orders.unionByName(helpers)


def bind_requests(spark: SparkSession, sf_dir: str, staff_by: str = "nation") -> DataFrame:
    """Order requests replaying every source order (seq = order key; empty
    arrays for an order without lines), with the same derived fields as
    ``bind_tables``.

    One pass: orders joined to their customer and nation (left joins, so an
    order without a customer keeps NULL name and staff), plus the order's
    lines gathered into arrays (bounded by the lines of one order, ordered
    by the full line so positions repeat run to run).
    """
    if staff_by not in STAFF_BINDINGS:
        raise ValueError(f"staff_by must be one of {STAFF_BINDINGS}")
    src_orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")

    typed = src_orders.select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("cust_id"),
        _order_type(F.col("o_orderpriority")).alias("order_type"),
        F.to_date("o_orderdate").alias("order_placed"))
    fn, ln = split_name("c_name", "#")
    cust = customer.select(F.col("c_custkey").cast("long").alias("cust_id"),
                           fn.alias("c_fname"), ln.alias("c_lname"),
                           F.col("c_nationkey").cast("long").alias("nation_id"),
                           F.col("c_mktsegment").alias("segment"))
    nat = nation.select(F.col("n_nationkey").cast("long").alias("nation_id"),
                        F.col("n_name").alias("n_city"),
                        F.col("n_regionkey").cast("long").alias("region_id"))
    lines = (lineitem.groupBy(F.col("l_orderkey").cast("long").alias("order_id"))
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col("l_linenumber"), F.col("l_partkey").cast("long").alias("p"),
                 F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey"),
                 F.col("l_shipdate")))).alias("ls")))
    req = (typed.join(cust, "cust_id", "left").join(nat, "nation_id", "left")
           .join(lines, "order_id", "left"))

    has_cust = F.col("c_fname").isNotNull()
    has_city = has_cust & F.col("n_city").isNotNull()
    is_coll = (F.col("order_type") == "Collection") & has_cust
    is_deli = (F.col("order_type") == "Delivery") & has_city
    named = is_coll | is_deli
    fmt = "dd-MMM-yy"
    staff = {"nation": F.col("nation_id"),
             "region": F.when(has_city, F.col("region_id")),
             "customer": F.when(has_cust, F.col("cust_id"))}[staff_by]
    return req.select(
        F.col("order_id").alias("seq"),
        "order_type",
        F.coalesce(F.col("ls.p"), F.array().cast("array<bigint>")).alias("products"),
        F.coalesce(F.col("ls.q"), F.array().cast("array<int>")).alias("quantities"),
        F.date_format("order_placed", fmt).alias("sale_date"),
        F.when(named, F.date_format(_due_date(F.col("order_placed"), F.col("order_id")), fmt))
         .alias("due_date"),
        F.when(named, F.col("c_fname")).alias("fname"),
        F.when(named, F.col("c_lname")).alias("lname"),
        F.when(is_deli, F.col("cust_id").cast("string")).alias("house"),
        F.when(is_deli, F.col("segment")).alias("street"),
        F.when(is_deli, F.col("n_city")).alias("city"),
        staff.alias("staff_id"))
