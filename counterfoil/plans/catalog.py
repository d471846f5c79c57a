"""Registered queries: name -> (DataFrame builder, oracle SQL or None).

Every query reads the whole driver tables through the binding and runs
the library operator on them; parameters are fixed here once (chosen so
that thresholds select a meaningful part of the data, SURVEY §7.5) and are
the same at every scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_request_date
from ..operators import arrivals as A
from ..operators import display as D
from ..operators import expiry as E
from ..operators import incremental as N
from ..operators import intake as I
from ..operators import quality as V
from ..operators import reports as R
from ..operators import stock as S
from ..operators.admission import admit_orders
from ..operators.timeline import ExpiryRun, admit_timeline
from ..sources.schemas import MAX_TEXT as V_MAX_TEXT
from ..sources.schemas import TABLE_SCHEMAS
from ..sources.files import read_requests_checked, read_tables
from ..sources.publish import publish, read_version
from ..sources.testdata import bind_requests, bind_tables
from ..streaming.orders_stream import stream_orders
from . import oracle as O
from ..session import ensure_checkpoint_dir
from .jobs import materialize_requests, place_orders
from .layout import store
from .views import register_views


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return deco


# Parameters for the driver's data.
TOP_PRODUCT_MIN = 1_110_000      # R5-R8: about 1 % of products at sf0.01
LIFETIME_MIN = 1_420_000         # R4 with customers as staff: about 10 %
YEAR_PRODUCT_MIN = 300_000       # R9-R13 with regions as staff
YEAR_STAFF_MIN = 49_600_000      # R11: about half of the (region, year) pairs at sf0.01


# ------------------------------------------------------------------ reports

@register("r2_product_revenue", O.with_binding(f"""
WITH {O.REVENUE}
SELECT product_id, product_desc, CAST(total_value AS DECIMAL(38,2)) AS total_value
FROM revenue JOIN b_inventory USING (product_id)
"""))
def q_product_revenue(spark, sf_dir):
    return R.product_revenue(bind_tables(spark, sf_dir))


@register("r1_sale_values", O.with_binding("""
SELECT staff_id, order_placed, product_id, order_id, CAST(price * quantity AS DECIMAL(38,2)) AS sale_value
FROM b_staff_orders JOIN b_orders USING (order_id) JOIN b_lines USING (order_id) JOIN b_inventory USING (product_id)
""", "region"))
def q_sale_values(spark, sf_dir):
    return R.sale_values(bind_tables(spark, sf_dir, "region"))


def _order_totals_sql(mode):
    return O.with_binding(f"""
WITH {O.linked(mode)}, {O.ORDER_TOTALS}
SELECT order_id, CAST(order_total AS DECIMAL(38,2)) AS order_total FROM totals
""", "customer")


@register("r3_order_totals", _order_totals_sql("strict"))
def q_order_totals(spark, sf_dir):
    return R.order_totals(bind_tables(spark, sf_dir, "customer"))


def _lifetime_sql(mode, staff_by):
    return O.with_binding(f"""
WITH {O.linked(mode)}, {O.ORDER_TOTALS}
SELECT st.fname || ' ' || st.lname AS full_name, st.staff_id,
       CAST(SUM(t.order_total) AS DECIMAL(38,2)) AS lifetime_sales
FROM b_staff_orders so JOIN totals t ON t.order_id = so.order_id
JOIN b_staff st ON st.staff_id = so.staff_id
GROUP BY st.staff_id, st.fname, st.lname
HAVING SUM(t.order_total) >= {LIFETIME_MIN}
""", staff_by)


@register("r4_staff_lifetime_sales", _lifetime_sql("strict", "customer"))
def q_lifetime(spark, sf_dir):
    return R.staff_lifetime_sales(bind_tables(spark, sf_dir, "customer"), LIFETIME_MIN)


@register("r4_staff_lifetime_sales_compat", _lifetime_sql("compat", "customer"))
def q_lifetime_compat(spark, sf_dir):
    return R.staff_lifetime_sales(bind_tables(spark, sf_dir, "customer"), LIFETIME_MIN,
                                  mode="compat")


TOP_SQL = f"""{O.REVENUE},
  top AS (SELECT product_id, total_value FROM revenue WHERE total_value > {TOP_PRODUCT_MIN}),
  top_units AS (SELECT staff_id, product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold
                FROM b_lines JOIN b_staff_orders USING (order_id)
                WHERE product_id IN (SELECT product_id FROM top) GROUP BY ALL),
  sellers AS (SELECT staff_id, fname, lname, product_id, units_sold,
                     CAST(price * units_sold AS DECIMAL(38,2)) AS value_sold
              FROM top_units JOIN b_inventory USING (product_id) JOIN b_staff USING (staff_id))"""


@register("r5_top_products", O.with_binding(f"""
WITH {TOP_SQL}
SELECT product_id, CAST(total_value AS DECIMAL(38,2)) AS total_value FROM top
"""))
def q_top_products(spark, sf_dir):
    return R.top_products(bind_tables(spark, sf_dir), TOP_PRODUCT_MIN)


@register("r6_top_product_sellers", O.with_binding(f"""
WITH {TOP_SQL}
SELECT * FROM sellers
"""))
def q_top_sellers(spark, sf_dir):
    return R.top_product_sellers(bind_tables(spark, sf_dir), TOP_PRODUCT_MIN)


@register("r7_staff_by_top_value", O.with_binding(f"""
WITH {TOP_SQL}
SELECT staff_id, CAST(SUM(value_sold) AS DECIMAL(38,2)) AS total_value FROM sellers GROUP BY staff_id
"""))
def q_staff_by_top(spark, sf_dir):
    return R.staff_by_top_value(bind_tables(spark, sf_dir), TOP_PRODUCT_MIN)


@register("r8_staff_product_units", O.with_binding(f"""
WITH {TOP_SQL},
  ranking AS (SELECT staff_id, CAST(SUM(value_sold) AS DECIMAL(38,2)) AS total_value
              FROM sellers GROUP BY staff_id)
SELECT s.staff_id, s.fname || ' ' || s.lname AS full_name, s.product_id, s.units_sold, r.total_value
FROM sellers s JOIN ranking r ON r.staff_id = s.staff_id
"""))
def q_units_long(spark, sf_dir):
    return R.staff_product_units(bind_tables(spark, sf_dir), TOP_PRODUCT_MIN)


@register("r8_staff_product_crosstab", O.with_binding(f"""
WITH {TOP_SQL}
SELECT staff_id, fname || ' ' || lname AS full_name, CAST(SUM(value_sold) AS DECIMAL(38,2)) AS total_value,
       string_agg(product_id || ':' || units_sold, ' ' ORDER BY product_id) AS cells
FROM sellers GROUP BY staff_id, fname, lname
"""))
def q_crosstab(spark, sf_dir):
    wide = R.staff_product_crosstab(bind_tables(spark, sf_dir), TOP_PRODUCT_MIN)
    return wide.withColumn("cells", F.array_join(F.transform(
        "cells", lambda c: F.concat_ws(":", c["product_id"].cast("string"), c["units_sold"].cast("string"))), " "))


def _yearly_sql(mode):
    return f"""
  {O.linked(mode).strip()},
  {O.ORDER_TOTALS.strip()},
  r9 AS (SELECT u.yr, u.product_id, CAST(i.price * u.units AS DECIMAL(38,2)) AS total_value
         FROM (SELECT k.yr, l.product_id, SUM(l.quantity * k.w) AS units
               FROM b_lines l JOIN linked k ON k.order_id = l.order_id
               GROUP BY k.yr, l.product_id) u
         JOIN b_inventory i ON i.product_id = u.product_id
         WHERE i.price * u.units > {YEAR_PRODUCT_MIN}),
  r10 AS ({"""SELECT DISTINCT CAST(year(o.order_placed) AS INTEGER) AS yr, so.staff_id, l.product_id
           FROM b_lines l JOIN b_orders o ON o.order_id = l.order_id
           JOIN b_staff_orders so ON so.order_id = l.order_id
           WHERE (CAST(year(o.order_placed) AS INTEGER), l.product_id) IN (SELECT yr, product_id FROM r9)"""
           if mode == "strict" else
           """SELECT DISTINCT r9.yr, so.staff_id, l.product_id
           FROM b_lines l JOIN b_staff_orders so ON so.order_id = l.order_id
           JOIN r9 ON r9.product_id = l.product_id"""}),
  r11 AS (SELECT so.staff_id, t.yr, CAST(SUM(t.order_total) AS DECIMAL(38,2)) AS total_sales
          FROM b_staff_orders so JOIN totals t ON t.order_id = so.order_id
          GROUP BY so.staff_id, t.yr
          HAVING SUM(t.order_total) >= {YEAR_STAFF_MIN}),
  cnt AS (SELECT staff_id, yr, COUNT(product_id) AS n_products FROM r10 GROUP BY staff_id, yr),
  r12 AS (SELECT DISTINCT st.fname || ' ' || st.lname AS full_name, c.staff_id, c.yr, c.n_products
          FROM cnt c JOIN b_staff st ON st.staff_id = c.staff_id
          WHERE {"(c.staff_id, c.yr) IN (SELECT staff_id, yr FROM r11)" if mode == "strict" else
                 "c.staff_id IN (SELECT staff_id FROM r11) AND c.yr IN (SELECT yr FROM r11)"}),
  need AS (SELECT yr, COUNT(*) AS n_products FROM r9 GROUP BY yr)"""


for _mode in ("strict", "compat"):
    sfx = "" if _mode == "strict" else "_compat"

    @register(f"r9_yearly_top_products{sfx}", O.with_binding(
        f"WITH {_yearly_sql(_mode)}\nSELECT * FROM r9", "region"))
    def _q9(spark, sf_dir, _m=_mode):
        return R.yearly_top_products(bind_tables(spark, sf_dir, "region"), YEAR_PRODUCT_MIN, mode=_m)

    @register(f"r10_staff_top_products{sfx}", O.with_binding(
        f"WITH {_yearly_sql(_mode)}\nSELECT * FROM r10", "region"))
    def _q10(spark, sf_dir, _m=_mode):
        return R.staff_top_products(bind_tables(spark, sf_dir, "region"), YEAR_PRODUCT_MIN, mode=_m)

    @register(f"r11_yearly_staff_sales{sfx}", O.with_binding(
        f"WITH {_yearly_sql(_mode)}\nSELECT * FROM r11", "region"))
    def _q11(spark, sf_dir, _m=_mode):
        return R.yearly_staff_sales(bind_tables(spark, sf_dir, "region"), YEAR_STAFF_MIN, mode=_m)

    @register(f"r12_staff_yearly_coverage{sfx}", O.with_binding(
        f"WITH {_yearly_sql(_mode)}\nSELECT * FROM r12", "region"))
    def _q12(spark, sf_dir, _m=_mode):
        return R.staff_yearly_coverage(bind_tables(spark, sf_dir, "region"), YEAR_PRODUCT_MIN,
                                       staff_min=YEAR_STAFF_MIN, mode=_m)

    @register(f"r13_employees_of_the_year{sfx}", O.with_binding(
        f"""WITH {_yearly_sql(_mode)}
SELECT r12.yr, r12.staff_id, r12.full_name FROM r12
JOIN need ON need.yr = r12.yr AND need.n_products = r12.n_products""", "region"))
    def _q13(spark, sf_dir, _m=_mode):
        return R.employees_of_the_year(bind_tables(spark, sf_dir, "region"), None, YEAR_PRODUCT_MIN,
                                       staff_min=YEAR_STAFF_MIN, mode=_m)


# The ledger in three batches: orders by order id modulo 3; the last batch
# also cancels what has expired by then.
def _by_deltas(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    keep = lambda df: df.checkpoint(eager=True)
    t = bind_tables(spark, sf_dir, "region")
    state = N.ledger_aggregates(_no_orders(spark, t))
    limits = dict(product_min=YEAR_PRODUCT_MIN, staff_min=YEAR_STAFF_MIN)
    won = N.winners(state, t.inventory, **limits)
    cancelled = E.expire_collections(t, EXPIRY_AS_OF, materialize=keep).cancelled
    for i in range(3):
        new = {n: getattr(t, n).filter(F.col("order_id") % 3 == i) for n in ("orders", "order_products", "staff_orders")}
        last = i == 2
        change = N.delta(new, t if last else None, cancelled if last else None)
        change = N.Aggregates(*[keep(df) for _, df in change.items()])
        state = N.merged(state, change, keep)
        won = keep(N.updated_winners(won, state, N.changed_years(change), t.inventory, **limits))
    return t, state, won


def _without_cancelled(sql: str) -> str:
    """``sql`` over the tables without the cancelled orders."""
    names = {"b_orders": "x_orders", "b_lines": "x_lines", "b_staff_orders": "x_staff_orders"}
    for b, x in names.items():
        sql = sql.replace(b, x)
    left = ", ".join(f"{x} AS (SELECT * FROM {b} WHERE order_id NOT IN (SELECT order_id FROM removed))" for b, x in names.items())
    return O.with_binding(f"WITH {EXPIRED_SQL}, {left}, {sql}", "region")


def _register_deltas():
    """R2, R9, R11 and R13 from aggregates kept under appended and cancelled orders."""
    @register("r2_revenue_by_deltas", _without_cancelled(f"""{O.REVENUE}
SELECT product_id, product_desc, CAST(total_value AS DECIMAL(38,2)) AS total_value FROM revenue JOIN b_inventory USING (product_id)"""))
    def q_r2(spark, sf_dir):
        t, state, _ = _by_deltas(spark, sf_dir)
        return N.product_revenue(state, t.inventory)

    @register("r9_yearly_top_by_deltas", _without_cancelled(f"{_yearly_sql('strict')}\nSELECT * FROM r9"))
    def q_r9(spark, sf_dir):
        t, state, _ = _by_deltas(spark, sf_dir)
        return N.yearly_top_products(state, t.inventory, YEAR_PRODUCT_MIN)

    @register("r11_yearly_sales_by_deltas", _without_cancelled(f"{_yearly_sql('strict')}\nSELECT * FROM r11"))
    def q_r11(spark, sf_dir):
        t, state, _ = _by_deltas(spark, sf_dir)
        return N.yearly_staff_sales(state, t.inventory, YEAR_STAFF_MIN)

    @register("r13_employees_by_deltas", _without_cancelled(f"""{_yearly_sql('strict')}
SELECT r12.yr, r12.staff_id, r12.full_name FROM r12 JOIN need ON need.yr = r12.yr AND need.n_products = r12.n_products"""))
    def q_r13(spark, sf_dir):
        t, _, won = _by_deltas(spark, sf_dir)
        return N.employees_of_the_year(won, t.staff)


@register("r14_report_lines", O.with_binding(f"""
WITH {O.REVENUE}
SELECT printf('%-30s%-1s%-30s%-1s%-30s', product_id || ',', ' ', product_desc || ',', ' ',
              '£' || CAST(trunc(total_value) AS BIGINT)) AS line
FROM revenue JOIN b_inventory USING (product_id)
"""))
def q_report_lines(spark, sf_dir):
    return D.report_lines(R.product_revenue(bind_tables(spark, sf_dir)))


@register("r14_report_lines_staff", f"""
SELECT printf('%-30s%-1s%-30s', full_name || ',', ' ', '£' || CAST(trunc(lifetime_sales) AS BIGINT)) AS line
FROM ({_lifetime_sql("strict", "customer")})
UNION ALL SELECT printf('%-30s%-1s%-30s', 'EmployeeName', ' ', 'TotalValueSold')
UNION ALL SELECT printf('%-30s%-1s%-30s', repeat('-', 30), ' ', repeat('-', 30))
""")
def q_report_lines_staff(spark, sf_dir):
    lines = D.report_lines(R.staff_lifetime_sales(bind_tables(spark, sf_dir, "customer"), LIFETIME_MIN))
    return spark.createDataFrame([(x,) for x in D.report_header("staff")], lines.schema).unionByName(lines)


# ------------------------------------------------------------------ expiry

EXPIRY_AS_OF = _dt.date(1998, 1, 1)     # about a third of the order dates precede it
EXPIRED_SQL = f"""
  uncollected AS (SELECT order_id, collection_date FROM b_collections
                  WHERE order_id IN (SELECT order_id FROM b_orders WHERE completed = 0)),
  expired AS (SELECT DISTINCT order_id FROM uncollected
              WHERE collection_date + 8 <= DATE '{EXPIRY_AS_OF}'),
  removed AS (SELECT order_id FROM expired
              WHERE order_id NOT IN (SELECT order_id FROM b_deliveries))"""


@register("e1_uncollected_collections", O.with_binding(f"WITH {EXPIRED_SQL}\nSELECT * FROM uncollected"))
def q_uncollected(spark, sf_dir):
    return E.uncollected_collections(bind_tables(spark, sf_dir))


@register("e2_expired_orders", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT * FROM uncollected WHERE collection_date + 8 <= DATE '{EXPIRY_AS_OF}'"""))
def q_expired(spark, sf_dir):
    return E.expired_orders(bind_tables(spark, sf_dir), EXPIRY_AS_OF)


@register("e3_remove_old_orders", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT * FROM b_orders WHERE order_id NOT IN (SELECT order_id FROM removed)"""))
def q_remove_old(spark, sf_dir):
    return E.remove_old_orders(bind_tables(spark, sf_dir), EXPIRY_AS_OF)


@register("e4_cascade_order_products", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT * FROM b_lines WHERE order_id NOT IN (SELECT order_id FROM removed)"""))
def q_cascade_lines(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).tables.order_products


@register("e4_cascade_collections", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT * FROM b_collections WHERE order_id NOT IN (SELECT order_id FROM removed)"""))
def q_cascade_collections(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).tables.collections


@register("e4_cascade_staff_orders", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT * FROM b_staff_orders WHERE order_id NOT IN (SELECT order_id FROM removed)"""))
def q_cascade_links(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).tables.staff_orders


DISCONTINUE_BELOW = 100   # E5: products with less stock than this are removed


@register("e5_cascade_from_parent", O.with_binding(f"""
SELECT * FROM b_lines WHERE product_id NOT IN
  (SELECT product_id FROM b_inventory WHERE stock < {DISCONTINUE_BELOW})"""))
def q_cascade_parent(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    gone = t.inventory.filter(F.col("stock") < DISCONTINUE_BELOW).select("product_id")
    return E.remove_products(t, gone).order_products


@register("e6_expire_collections_stock", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT i.product_id, i.product_desc, i.price, i.stock + COALESCE(r.q, 0) AS stock
FROM b_inventory i LEFT JOIN (
  SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS q FROM b_lines
  WHERE order_id IN (SELECT order_id FROM removed) GROUP BY product_id) r
ON r.product_id = i.product_id"""))
def q_expire_stock(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).tables.inventory


@register("e6_cancelled_orders", O.with_binding(f"WITH {EXPIRED_SQL}\nSELECT order_id FROM removed"))
def q_cancelled(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).cancelled


@register("e6_blocked_orders", O.with_binding(
    f"WITH {EXPIRED_SQL}\nSELECT order_id FROM expired WHERE order_id IN (SELECT order_id FROM b_deliveries)"))
def q_blocked(spark, sf_dir):
    return E.expire_collections(bind_tables(spark, sf_dir), EXPIRY_AS_OF).blocked


LEAVING_BELOW = 5   # E5: staff with a smaller id are removed


@register("e5_cascade_from_staff", O.with_binding(f"""
SELECT * FROM b_staff_orders WHERE staff_id IN (SELECT staff_id FROM b_staff WHERE staff_id >= {LEAVING_BELOW})"""))
def q_cascade_staff(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    return E.remove_staff(t, t.staff.filter(F.col("staff_id") < LEAVING_BELOW)).staff_orders


# ------------------------------------------------------------------ stock

_register_deltas()


@register("d1_reduce_stock", O.with_binding("""
SELECT i.product_id, i.product_desc, i.price, i.stock - COALESCE(s.q, 0) AS stock
FROM b_inventory i LEFT JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS q FROM b_lines GROUP BY product_id) s
ON s.product_id = i.product_id"""))
def q_reduce_stock(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    return S.reduce_stock(t.inventory, t.order_products)


@register("d2_restock", O.with_binding("""
SELECT i.product_id, i.product_desc, i.price, i.stock + COALESCE(s.q, 0) AS stock
FROM b_inventory i LEFT JOIN (
  SELECT l.product_id, CAST(SUM(l.quantity) AS BIGINT) AS q FROM b_lines l JOIN b_orders o ON o.order_id = l.order_id
  WHERE o.completed = 0 GROUP BY l.product_id) s
ON s.product_id = i.product_id"""))
def q_restock(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    open_lines = t.order_products.join(t.orders.filter(F.col("completed") == 0), "order_id", "left_semi")
    return S.restock(t.inventory, open_lines)


# Request lines in array order: gathered per order, sorted by the full line.
REQUEST_LINES_SQL = """
  req_lines AS (SELECT CAST(l_orderkey AS BIGINT) AS seq,
                       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                            l_quantity, l_suppkey, l_shipdate) - 1 AS INTEGER) AS pos,
                       CAST(l_partkey AS BIGINT) AS product_id, CAST(l_quantity AS INTEGER) AS quantity
                FROM lineitem)"""


@register("d3_stock_levels", O.with_binding(f"""WITH {REQUEST_LINES_SQL}
SELECT r.seq, r.pos, r.product_id, i.stock FROM req_lines r
LEFT JOIN b_inventory i ON i.product_id = r.product_id"""))
def q_stock_levels(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    return S.stock_levels(t.inventory, I.explode_order_lines(bind_requests(spark, sf_dir)))


@register("d4_sufficient_stock", O.with_binding("""
SELECT l.product_id, l.order_id, l.quantity, i.stock, i.stock >= l.quantity AS sufficient
FROM b_lines l LEFT JOIN b_inventory i ON i.product_id = l.product_id"""))
def q_sufficient(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    return S.sufficient_stock(t.order_products, t.inventory)


@register("d5_fulfilment_type", O.with_binding("""
SELECT o.order_id, 'InStore' AS stored_type,
       CASE WHEN o.order_id IN (SELECT order_id FROM b_deliveries) THEN 'Delivery'
            WHEN o.order_id IN (SELECT order_id FROM b_collections) THEN 'Collection'
            ELSE 'InStore' END AS order_type
FROM b_orders o"""))
def q_fulfilment(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    # data as the reference stored it: every order typed 'InStore' (Q1)
    stored = t.orders.withColumn("order_type", F.lit("InStore"))
    return S.fulfilment_type(stored, t.collections, t.deliveries)


# ------------------------------------------------------------------ integrity

# The bound tables with rows that break each rule, by rules on their ids.
SPOIL_EVERY, SPOIL_ID = 211, 10_000_000_000
SPOILED_SQL = f"""
  s_inventory AS (SELECT product_id, CASE product_id % {SPOIL_EVERY} WHEN 1 THEN NULL WHEN 2 THEN repeat('x', 31) ELSE product_desc END AS product_desc,
                         CASE WHEN product_id % {SPOIL_EVERY} = 3 THEN 1000000 ELSE price END AS price, stock
                  FROM (FROM b_inventory UNION ALL FROM b_inventory WHERE product_id % {SPOIL_EVERY} = 4)),
  s_orders AS (SELECT order_id, CASE order_id % {SPOIL_EVERY} WHEN 1 THEN 'Post' WHEN 2 THEN NULL ELSE order_type END AS order_type,
                      CASE WHEN order_id % {SPOIL_EVERY} = 3 THEN 2 ELSE completed END AS completed, order_placed
               FROM (FROM b_orders UNION ALL FROM b_orders WHERE order_id % {SPOIL_EVERY} = 0)),
  s_lines AS (SELECT CASE WHEN order_id % {SPOIL_EVERY} = 5 THEN order_id + {SPOIL_ID} ELSE order_id END AS order_id,
                     CASE WHEN order_id % {SPOIL_EVERY} = 6 THEN -7 ELSE product_id END AS product_id,
                     CASE WHEN order_id % {SPOIL_EVERY} = 4 THEN 0 ELSE quantity END AS quantity FROM b_lines),
  s_collections AS (SELECT order_id, fname, CASE WHEN order_id % {SPOIL_EVERY} = 8 THEN repeat('x', 31) ELSE lname END AS lname,
                           CASE WHEN order_id % {SPOIL_EVERY} = 7 THEN collection_date - 400 ELSE collection_date END AS collection_date
                    FROM b_collections),
  s_deliveries AS (SELECT CASE WHEN order_id % {SPOIL_EVERY} = 11 THEN order_id + {SPOIL_ID} ELSE order_id END AS order_id, fname, lname,
                          house, street, CASE WHEN order_id % {SPOIL_EVERY} = 10 THEN NULL ELSE city END AS city,
                          CASE WHEN order_id % {SPOIL_EVERY} = 9 THEN delivery_date - 400 ELSE delivery_date END AS delivery_date
                   FROM b_deliveries),
  s_staff AS (SELECT staff_id, CASE WHEN staff_id = 3 THEN NULL ELSE fname END AS fname, lname
              FROM (FROM b_staff UNION ALL FROM b_staff WHERE staff_id = 4)),
  s_staff_orders AS (SELECT CASE WHEN order_id % {SPOIL_EVERY} = 12 THEN staff_id + {SPOIL_ID} ELSE staff_id END AS staff_id, order_id
                     FROM b_staff_orders)"""


def _spoiled(t):
    def when(key, k, bad, column):
        return F.when(F.col(key) % SPOIL_EVERY == k, bad).otherwise(F.col(column))

    def twice(df, cond):
        return df.unionByName(df.filter(cond))
    long, order = F.repeat(F.lit("x"), F.lit(31)), "order_id"
    away = F.col(order) + SPOIL_ID
    desc = F.when(F.col("product_id") % SPOIL_EVERY == 1, F.lit(None)).otherwise(when("product_id", 2, long, "product_desc"))
    kind = F.when(F.col(order) % SPOIL_EVERY == 1, "Post").otherwise(when(order, 2, F.lit(None), "order_type"))
    return t.replace(
        inventory=twice(t.inventory, F.col("product_id") % SPOIL_EVERY == 4).withColumns({
            "product_desc": desc, "price": when("product_id", 3, F.lit(1000000).cast("decimal(9,2)"), "price")}),
        orders=twice(t.orders, F.col(order) % SPOIL_EVERY == 0).withColumns({
            "order_type": kind, "completed": when(order, 3, 2, "completed")}),
        order_products=t.order_products.withColumns({
            "product_id": when(order, 6, -7, "product_id"), "quantity": when(order, 4, 0, "quantity"),
            order: when(order, 5, away, order)}),
        collections=t.collections.withColumns({
            "lname": when(order, 8, long, "lname"),
            "collection_date": when(order, 7, F.date_sub("collection_date", 400), "collection_date")}),
        deliveries=t.deliveries.withColumns({
            "city": when(order, 10, F.lit(None), "city"), order: when(order, 11, away, order),
            "delivery_date": when(order, 9, F.date_sub("delivery_date", 400), "delivery_date")}),
        staff=twice(t.staff, F.col("staff_id") == 4).withColumn(
            "fname", F.when(F.col("staff_id") != 3, F.col("fname"))),
        staff_orders=t.staff_orders.withColumn("staff_id", when(order, 12, F.col("staff_id") + SPOIL_ID, "staff_id")))


def _integrity_sql() -> str:
    """Every V1-V8 rule as SQL over the spoiled tables, one SELECT per rule."""
    names = {"inventory": "s_inventory", "orders": "s_orders", "order_products": "s_lines",
             "deliveries": "s_deliveries", "collections": "s_collections", "staff": "s_staff",
             "staff_orders": "s_staff_orders"}
    keys = {"order_products": ["order_id", "product_id"], "deliveries": ["order_id"],
            "collections": ["order_id"], "staff_orders": ["staff_id", "order_id"],
            **V.PRIMARY_KEYS}

    def key(cols, alias=""):
        return " || '|' || ".join(f"COALESCE(CAST({alias}{c} AS VARCHAR), 'NULL')" for c in cols)

    parts = []
    for t, k in V.PRIMARY_KEYS.items():
        nulls = " OR ".join(f"{c} IS NULL" for c in k)
        parts.append(f"SELECT 'V1' AS rule, '{t}' AS table_name, {key(k)} AS row_key FROM {names[t]} "
                     f"GROUP BY {', '.join(k)} HAVING COUNT(*) > 1 OR {nulls}")
    for child, col, parent, pcol in V.FOREIGN_KEYS:
        parts.append(f"SELECT 'V2', '{child}', {key([col])} FROM {names[child]} "
                     f"WHERE {col} IS NULL OR {col} NOT IN (SELECT {pcol} FROM {names[parent]} "
                     f"WHERE {pcol} IS NOT NULL)")
    parts.append("SELECT 'V3', 'orders', " + key(["order_id"]) + " FROM s_orders WHERE order_type IS NULL "
                 "OR order_type NOT IN ('InStore', 'Collection', 'Delivery')")
    parts.append("SELECT 'V4', 'orders', " + key(["order_id"]) + " FROM s_orders WHERE completed IS NULL "
                 "OR completed NOT IN (0, 1)")
    for t, schema in TABLE_SCHEMAS.items():
        for f in schema.fields:
            if not f.nullable:
                parts.append(f"SELECT 'V5', '{t}', {key(keys[t])} FROM {names[t]} WHERE {f.name} IS NULL")
    parts.append("SELECT 'V6', 'order_products', " + key(["order_id", "product_id"]) +
                 " FROM s_lines WHERE quantity <= 0")
    for t, col in (("collections", "collection_date"), ("deliveries", "delivery_date")):
        parts.append(f"SELECT 'V7', '{t}', {key(['order_id'], 'x.')} FROM {names[t]} x "
                     f"JOIN (SELECT order_id, MAX(order_placed) AS order_placed FROM s_orders GROUP BY order_id) o ON o.order_id = x.order_id WHERE x.{col} < o.order_placed")
    for t, cols in V.TEXT_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT 'V8', '{t}', {key(keys[t])} FROM {names[t]} WHERE length({c}) > {V_MAX_TEXT}")
    parts.append(f"SELECT 'V8', 'inventory', {key(['product_id'])} FROM s_inventory "
                 f"WHERE abs(price) >= {V.MAX_PRICE_EXCLUSIVE}")
    return O.with_binding(f"WITH {SPOILED_SQL}\n" + "\nUNION ALL ".join(parts))


@register("v_integrity_violations", _integrity_sql())
def q_integrity(spark, sf_dir):
    return V.validate_tables(_spoiled(bind_tables(spark, sf_dir))).select("rule", "table_name", "row_key")


def _cascade_sql() -> str:
    """Rejects of the spoiled tables by a recursive walk down the foreign keys."""
    names = {"inventory": "s_inventory", "orders": "s_orders", "order_products": "s_lines", "deliveries": "s_deliveries",
             "collections": "s_collections", "staff": "s_staff", "staff_orders": "s_staff_orders"}
    key = {t: " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'NULL')" for c in cols) for t, cols in V.ROW_KEYS.items()}
    ctes = [f"n_{t} AS MATERIALIZED (SELECT row_number() OVER () AS rid, {key[t]} AS row_key, * FROM {s})" for t, s in names.items()]
    own = []

    def rule(name, t, cond):
        own.append(f"SELECT '{name}' AS rule, '{t}' AS tn, rid FROM n_{t} WHERE {cond}")
    for t, (k,) in V.PRIMARY_KEYS.items():
        rule("V1", t, f"{k} IS NULL OR {k} IN (SELECT {k} FROM n_{t} GROUP BY {k} HAVING COUNT(*) > 1)")
    for child, col, parent, pcol in V.FOREIGN_KEYS:
        rule("V2", child, f"{col} IS NULL OR {col} NOT IN (SELECT {pcol} FROM n_{parent} WHERE {pcol} IS NOT NULL)")
    rule("V3", "orders", "order_type IS NULL OR order_type NOT IN ('InStore', 'Collection', 'Delivery')")
    rule("V4", "orders", "completed IS NULL OR completed NOT IN (0, 1)")
    rule("V6", "order_products", "quantity <= 0")
    rule("V8", "inventory", f"abs(price) >= {V.MAX_PRICE_EXCLUSIVE}")
    for t, schema in TABLE_SCHEMAS.items():
        for f in schema.fields:
            if not f.nullable:
                rule("V5", t, f"{f.name} IS NULL")
        for c in V.TEXT_COLUMNS.get(t, []):
            rule("V8", t, f"length({c}) > {V_MAX_TEXT}")
    for t, c in V.DUE_DATES.items():
        rule("V7", t, f"{c} < (SELECT max(order_placed) FROM n_orders o WHERE o.order_id = n_{t}.order_id)")
    edges = [f"SELECT '{child}' AS tn, c.rid, '{parent}' AS ptn, p.rid AS prid FROM n_{child} c JOIN n_{parent} p ON p.{pcol} = c.{col}"
             for child, col, parent, pcol in V.FOREIGN_KEYS]
    keys = [f"SELECT '{t}' AS tn, rid, row_key FROM n_{t}" for t in names]
    body = f"""{SPOILED_SQL}, {", ".join(ctes)},
  own AS MATERIALIZED ({" UNION ALL ".join(own)}), edges AS MATERIALIZED ({" UNION ALL ".join(edges)}),
  bad(tn, rid) AS (SELECT tn, rid FROM own UNION SELECT e.tn, e.rid FROM bad JOIN edges e ON e.ptn = bad.tn AND e.prid = bad.rid),
  why AS (SELECT tn, rid, rule FROM own
          UNION ALL SELECT e.tn, e.rid, 'cascade' FROM edges e JOIN bad ON bad.tn = e.ptn AND bad.rid = e.prid),
  keys AS ({" UNION ALL ".join(keys)})"""
    return O.with_binding(f"WITH {body}\n").replace("WITH", "WITH RECURSIVE", 1)


@register("v_cascade_rejects", _cascade_sql() + """
SELECT tn AS table_name, row_key, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reasons
FROM why JOIN keys USING (tn, rid) GROUP BY tn, rid, row_key""")
def q_cascade(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    cleaned = V.clean_tables(_spoiled(bind_tables(spark, sf_dir)), lambda df: df.checkpoint(eager=True))
    return cleaned.rejects.withColumn("reasons", F.array_join("reasons", ","))


@register("v_valid_tables", _cascade_sql() + """
SELECT tn AS table_name, row_key, count(*) AS n_rows
FROM keys ANTI JOIN bad USING (tn, rid) GROUP BY tn, row_key""")
def q_valid_tables(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    valid = V.clean_tables(_spoiled(bind_tables(spark, sf_dir)), lambda df: df.checkpoint(eager=True)).tables
    parts = [df.select(F.lit(name).alias("table_name"), V._key(V.ROW_KEYS[name]).alias("row_key")) for name, df in valid.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("table_name", "row_key").agg(F.count(F.lit(1)).alias("n_rows"))


# Orders above this share of all order ids arrive as a batch; some of them
# repeat an id of the ledger, some lines and links name nothing that is there.
ARRIVING = "order_id % 5 = 4"


def _arrivals(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    new = F.expr(ARRIVING)
    old = t.replace(orders=t.orders.filter(~new), order_products=t.order_products.filter(~new),
                    staff_orders=t.staff_orders.filter(~new))
    k = F.col("order_id") % 35
    batch = {
        "orders": t.orders.filter(new).withColumn("order_id", F.when(k == 4, F.col("order_id") - 1).otherwise(F.col("order_id"))),
        "order_products": t.order_products.filter(new).withColumn(
            "product_id", F.when(k == 9, F.col("product_id") + SPOIL_ID).otherwise(F.col("product_id"))),
        "staff_orders": t.staff_orders.filter(new).withColumn(
            "staff_id", F.when(k == 14, F.col("staff_id") + 100).otherwise(F.col("staff_id")))}
    return batch, old


@register("v_arriving_violations", O.with_binding(f"""
WITH old_orders AS (SELECT order_id FROM b_orders WHERE NOT ({ARRIVING})),
new_orders AS (SELECT CASE WHEN order_id % 35 = 4 THEN order_id - 1 ELSE order_id END AS order_id FROM b_orders WHERE {ARRIVING}),
there AS (SELECT order_id FROM old_orders UNION SELECT order_id FROM new_orders),
new_lines AS (SELECT order_id, CASE WHEN order_id % 35 = 9 THEN product_id + {SPOIL_ID} ELSE product_id END AS product_id
              FROM b_lines WHERE {ARRIVING}),
new_links AS (SELECT order_id, CASE WHEN order_id % 35 = 14 THEN staff_id + 100 ELSE staff_id END AS staff_id
              FROM b_staff_orders WHERE {ARRIVING})
SELECT 'V1' AS rule, 'orders' AS table_name, CAST(order_id AS VARCHAR) AS row_key FROM new_orders
GROUP BY order_id HAVING count(*) > 1 OR order_id IN (SELECT order_id FROM old_orders)
UNION ALL SELECT 'V2', 'order_products', CAST(order_id AS VARCHAR) FROM new_lines WHERE order_id NOT IN (SELECT order_id FROM there)
UNION ALL SELECT 'V2', 'order_products', CAST(product_id AS VARCHAR) FROM new_lines
          WHERE product_id NOT IN (SELECT product_id FROM b_inventory)
UNION ALL SELECT 'V2', 'staff_orders', CAST(order_id AS VARCHAR) FROM new_links WHERE order_id NOT IN (SELECT order_id FROM there)
UNION ALL SELECT 'V2', 'staff_orders', CAST(staff_id AS VARCHAR) FROM new_links WHERE staff_id NOT IN (SELECT staff_id FROM b_staff)"""))
def q_arrivals(spark, sf_dir):
    batch, old = _arrivals(spark, sf_dir)
    return A.check_arrivals(batch, old).select("rule", "table_name", "row_key")


LINES_PER_BUCKET = 2_000_000     # about 128 MB of the layout's lines


@register("e6_returned_stock_layout", O.with_binding(f"""WITH {EXPIRED_SQL}
SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS quantity FROM b_lines
WHERE order_id IN (SELECT order_id FROM removed) GROUP BY product_id"""))
def q_returned(spark, sf_dir):
    """E6's restock from the stored layout: the months of expired orders only."""
    t, name = bind_tables(spark, sf_dir), f"layout_{uuid.uuid4().hex}"
    buckets = t.order_products.count() // LINES_PER_BUCKET + 1
    return store(t, name, f"{ensure_checkpoint_dir(spark)}/{name}", buckets).returned_stock(EXPIRY_AS_OF)


# ------------------------------------------------------------------ sources

FORMATS = ("parquet", "orc", "csv", "json")
_SCAN_SUMS = {"inventory": "product_id", "orders": "order_id", "order_products": "quantity", "deliveries": "order_id",
              "collections": "order_id", "staff": "staff_id", "staff_orders": "staff_id"}
_SCAN_TEXT = {"inventory": "product_desc", "orders": "order_type", "order_products": None, "deliveries": "city",
              "collections": "lname", "staff": "fname", "staff_orders": None}
_B_NAMES = {"order_products": "b_lines"}


@register("s_read_tables", O.with_binding("WITH scans AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum({c}) AS BIGINT) AS key_sum, "
    f"CAST({f'sum(length({_SCAN_TEXT[t]}))' if _SCAN_TEXT[t] else '0'} AS BIGINT) AS text_length FROM {_B_NAMES.get(t, 'b_' + t)}"
    for t, c in _SCAN_SUMS.items()) + f") SELECT unnest({list(FORMATS)}) AS format, * FROM scans"))
def q_read_tables(spark, sf_dir):
    """The tables written in each file format and read by their declared schemas."""
    base = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    t = bind_tables(spark, sf_dir)
    out = None
    for fmt in FORMATS:
        for name, df in t.items():
            df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{base}/{fmt}/{name}")
        for name, df in read_tables(spark, f"{base}/{fmt}", fmt).items():
            text = F.sum(F.length(_SCAN_TEXT[name])) if _SCAN_TEXT[name] else F.lit(0)
            one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(_SCAN_SUMS[name]).cast("bigint").alias("key_sum"),
                         text.cast("bigint").alias("text_length"))
            one = one.select(F.lit(fmt).alias("format"), F.lit(name).alias("table_name"), "n_rows", "key_sum", "text_length")
            out = one if out is None else out.unionByName(one)
    return out


# Request lines as JSON text, some of them broken: cut off, or with a value of another type.
BREAK_EVERY = 97


@register("s8_request_quarantine", O.with_binding(f"""
WITH lines AS (SELECT order_id, order_id % {BREAK_EVERY} AS k FROM b_orders)
SELECT order_id AS seq, CASE k WHEN 1 THEN 'not json' WHEN 2 THEN 'type of quantities' WHEN 3 THEN 'type of staff_id' END AS reason
FROM lines"""))
def q_quarantine(spark, sf_dir):
    """Every line comes out once, as a request or quarantined with its reason."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    reqs, k = bind_requests(spark, sf_dir), F.col("seq") % BREAK_EVERY
    line = F.to_json(F.struct(*[F.col(c) for c in reqs.columns]), {"ignoreNullFields": "false"})
    broken = (F.when(k == 1, F.substr(line, F.lit(1), F.length(line) - 3))
              .when(k == 2, F.regexp_replace(line, r'"quantities":\[[^\]]*\]', '"quantities":["many"]'))
              .when(k == 3, F.regexp_replace(line, r'"staff_id":[^,}]*', '"staff_id":"somebody"')).otherwise(line))
    reqs.select(broken.alias("value")).write.text(path)
    read = read_requests_checked(spark, path, lambda df: df.checkpoint(eager=True))
    seq = F.regexp_extract("text", r'"seq":(\d+)', 1).cast("bigint")
    return read.requests.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(
        read.quarantine.select(seq.alias("seq"), "reason"))


@register("s9_view_product_revenue", REGISTRY["r2_product_revenue"].sql)
def q_view(spark, sf_dir):
    """All columns of a view."""
    register_views(bind_tables(spark, sf_dir), prefix="s9_")
    return spark.sql("SELECT * FROM s9_product_revenue")


@register("s10_view_columns", f"SELECT full_name, lifetime_sales FROM ({_lifetime_sql('strict', 'customer')}) AS v")
def q_view_columns(spark, sf_dir):
    """Two columns of a view."""
    register_views(bind_tables(spark, sf_dir, "customer"), lifetime_min=LIFETIME_MIN, prefix="s10_")
    return spark.sql("SELECT full_name, lifetime_sales FROM s10_lifetime_sales")


# ------------------------------------------------------------------ intake

@register("c1_explode_order_lines", O.with_binding(f"WITH {REQUEST_LINES_SQL}\nSELECT * FROM req_lines"))
def q_explode(spark, sf_dir):
    return I.explode_order_lines(bind_requests(spark, sf_dir))


@register("c10_parse_request_date", O.with_binding("""
SELECT o.order_id AS seq, o.order_placed AS sale_day, COALESCE(c.collection_date, d.delivery_date) AS due_day
FROM b_orders o
LEFT JOIN b_collections c ON c.order_id = o.order_id
LEFT JOIN b_deliveries d ON d.order_id = o.order_id"""))
def q_parse_dates(spark, sf_dir):
    reqs = bind_requests(spark, sf_dir)
    return reqs.select("seq", parse_request_date("sale_date").alias("sale_day"),
                       parse_request_date("due_date").alias("due_day"))


ID_START = 1_000_000


@register("c2_assign_order_ids", O.with_binding(f"""
SELECT order_id AS seq, CASE WHEN has_lines THEN {ID_START} - 1 + SUM(has_lines::INT) OVER (ORDER BY order_id) END::BIGINT AS order_id
FROM (SELECT order_id, order_id IN (SELECT order_id FROM b_lines) AS has_lines FROM b_orders)"""))
def q_assign_ids(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    v = I.validate_requests(bind_requests(spark, sf_dir), t.inventory, t.staff)
    return I.assign_order_ids(v.select("seq", "reason"), ID_START).select("seq", "order_id")


ORDER_TABLES = ("orders", "order_products", "staff_orders", "collections", "deliveries")


def _no_orders(spark, t):
    """The bound inventory and staff with no orders yet (empty tables of
    the declared schemas)."""
    return t.replace(**{n: spark.createDataFrame([], TABLE_SCHEMAS[n]) for n in ORDER_TABLES})


def _replay(spark, sf_dir, staff_by="nation"):
    """Every source order replayed as a request into a ledger without
    orders and with untracked stock: all are accepted, so the built rows are
    checkable against the source."""
    t = _no_orders(spark, bind_tables(spark, sf_dir, staff_by))
    t = t.replace(inventory=t.inventory.withColumn("stock", F.lit(None).cast("long")))
    return place_orders(t, bind_requests(spark, sf_dir, staff_by), id_start=ID_START).tables


REPLAY_SQL = f"""
  ids AS (SELECT o.order_id AS seq, {ID_START} - 1 + row_number() OVER (ORDER BY o.order_id) AS order_id
          FROM b_orders o JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.order_id)"""


@register("c4_build_orders", O.with_binding(f"""WITH {REPLAY_SQL}
SELECT ids.order_id, o.order_type, CAST(CASE WHEN o.order_type = 'InStore' THEN 1 ELSE 0 END AS INTEGER) AS completed,
       o.order_placed
FROM ids JOIN b_orders o ON o.order_id = ids.seq"""))
def q_build_orders(spark, sf_dir):
    return _replay(spark, sf_dir).orders


@register("c5_build_order_products", O.with_binding(f"""WITH {REPLAY_SQL}
SELECT ids.order_id, l.product_id, l.quantity FROM ids JOIN b_lines l ON l.order_id = ids.seq"""))
def q_build_lines(spark, sf_dir):
    return _replay(spark, sf_dir).order_products


@register("c6_build_staff_orders", O.with_binding(f"""WITH {REPLAY_SQL}
SELECT s.staff_id, ids.order_id FROM ids JOIN b_sold_by s ON s.order_id = ids.seq""", "region"))
def q_build_links(spark, sf_dir):
    return _replay(spark, sf_dir, "region").staff_orders


@register("c7_build_collections", O.with_binding(f"""WITH {REPLAY_SQL}
SELECT ids.order_id, c.fname, c.lname, c.collection_date FROM ids JOIN b_collections c ON c.order_id = ids.seq"""))
def q_build_collections(spark, sf_dir):
    return _replay(spark, sf_dir).collections


@register("c8_build_deliveries", O.with_binding(f"""WITH {REPLAY_SQL}
SELECT ids.order_id, d.fname, d.lname, d.house, d.street, d.city, d.delivery_date
FROM ids JOIN b_deliveries d ON d.order_id = ids.seq
WHERE ids.seq NOT IN (SELECT order_id FROM b_collections)"""))
def q_build_deliveries(spark, sf_dir):
    return _replay(spark, sf_dir).deliveries


# Beside the replayed orders, copies of some of them with one thing wrong, so
# that every reason to reject a request is met.  ``kind`` is the source's
# order id modulo FLAW_EVERY.
FLAW_EVERY, FLAW_ID = 101, 1_000_000_000
FLAWS = ("type", "date", "lines", "quantity", "product", "staff", "again", "no seq", "text")


def _flawed_requests(spark, sf_dir):
    reqs = bind_requests(spark, sf_dir)
    # every request, and some a second time with a flaw: one pass over the input
    kind, none = (F.col("seq") % FLAW_EVERY).cast("int"), F.lit(None).cast("string")
    named = F.element_at(F.array(*[F.lit(f) for f in FLAWS]), F.least(kind + 1, F.lit(len(FLAWS))))
    reqs = reqs.withColumn("flaw", F.explode(F.when(kind < len(FLAWS), F.array(none, named)).otherwise(F.array(none))))
    is_ = {name: F.col("flaw") == name for name in FLAWS}
    return reqs.select(
        F.when(F.col("flaw").isNull() | is_["again"], F.col("seq"))
         .when(~is_["no seq"], F.col("seq") + FLAW_ID).alias("seq"),
        F.when(is_["type"], "Post").otherwise(F.col("order_type")).alias("order_type"),
        F.when(is_["product"], F.transform("products", lambda p: p + 5 * FLAW_ID))
         .when(is_["lines"], F.slice("products", 2, 1000)).otherwise(F.col("products")).alias("products"),
        F.when(is_["quantity"], F.transform("quantities", lambda q: F.lit(0)))
         .otherwise(F.col("quantities")).alias("quantities"),
        F.when(is_["date"], "32-Jan-20").otherwise(F.col("sale_date")).alias("sale_date"), "due_date",
        F.when(is_["text"], F.repeat(F.lit("x"), F.lit(31))).otherwise(F.col("fname")).alias("fname"),
        "lname", "house", "street", "city",
        F.when(is_["staff"], -1).otherwise(F.col("staff_id")).alias("staff_id"))


# The sequential meaning as a fold over the orders in arrival order: the
# accumulator carries the stock of every product and the verdicts so far.
_FLAWED_SQL = f"""
            UNION ALL
            SELECT CASE flaw WHEN 'again' THEN src WHEN 'no seq' THEN NULL ELSE src + {FLAW_ID} END, src, order_type, flaw
            FROM (SELECT order_id AS src, order_type, list_extract({list(FLAWS)}, (order_id % {FLAW_EVERY} + 1)::INT) AS flaw
                  FROM b_orders WHERE order_id % {FLAW_EVERY} < {len(FLAWS)})"""


def _wants_sql(flawed: str) -> str:
    return f"""
  asked AS (SELECT order_id AS seq, order_id AS src, order_type, 'fine' AS flaw FROM b_orders{flawed}),
  checked AS (SELECT seq, src, CASE
                WHEN seq IS NULL OR COUNT(*) OVER (PARTITION BY seq) > 1 THEN 'seq'
                WHEN flaw IN ('type', 'date') THEN flaw
                WHEN flaw = 'lines' OR src NOT IN (SELECT order_id FROM b_lines) THEN 'lines'
                WHEN flaw = 'quantity' THEN flaw
                WHEN flaw = 'text' AND order_type <> 'InStore' THEN flaw
                WHEN flaw IN ('product', 'staff') THEN flaw END AS reason
              FROM asked),
  shelf AS (SELECT product_id, stock, row_number() OVER (ORDER BY product_id) AS place
            FROM b_inventory WHERE product_id IN (SELECT product_id FROM b_lines)),
  wants AS (SELECT seq, list(place) AS places, list(q) AS amounts
            FROM (SELECT c.seq, s.place, CAST(SUM(l.quantity) AS BIGINT) AS q
                  FROM checked c JOIN b_lines l ON l.order_id = c.src JOIN shelf s ON s.product_id = l.product_id
                  WHERE c.reason IS NULL GROUP BY c.seq, s.place) GROUP BY seq)"""


def _fold_sql(flawed: str) -> str:
    return f"""{_wants_sql(flawed)},
  folded AS (
    SELECT list_reduce(
      list_concat([(SELECT struct_pack(stock := list(stock ORDER BY place), places := []::BIGINT[], amounts := []::BIGINT[],
                                       accepted := []::BOOLEAN[]) FROM shelf)],
                  list(struct_pack(stock := []::BIGINT[], places := places, amounts := amounts, accepted := []::BOOLEAN[])
                       ORDER BY seq)),
      lambda acc, x: CASE
        WHEN list_bool_and(list_transform(x.places, lambda p, i: coalesce(acc.stock[p] >= x.amounts[i], true)))
        THEN struct_pack(stock := list_transform(acc.stock, lambda s, p: s - coalesce(x.amounts[list_position(x.places, p)], 0)),
                         places := []::BIGINT[], amounts := []::BIGINT[], accepted := list_append(acc.accepted, true))
        ELSE struct_pack(stock := acc.stock, places := []::BIGINT[], amounts := []::BIGINT[],
                         accepted := list_append(acc.accepted, false)) END) AS f
    FROM wants),
  verdict AS (SELECT unnest((SELECT list(seq ORDER BY seq) FROM wants)) AS seq, unnest(f.accepted) AS fits FROM folded),
  decided AS (SELECT c.seq, c.src, CASE WHEN c.reason IS NULL AND NOT v.fits THEN 'stock' ELSE c.reason END AS reason
              FROM checked c LEFT JOIN verdict v ON v.seq = c.seq),
  numbered AS (SELECT *, CASE WHEN coalesce(reason NOT IN ('seq', 'type', 'date', 'lines', 'quantity'), true)
                         THEN {ID_START} - 1 + COUNT(*) FILTER (WHERE coalesce(reason NOT IN ('seq', 'type', 'date', 'lines', 'quantity'), true))
                              OVER (ORDER BY seq) END AS order_id
               FROM decided)"""


FOLD_SQL = _fold_sql(_FLAWED_SQL)


@register("c3_admit_orders", O.with_binding(f"""WITH {FOLD_SQL}
SELECT seq, reason IS NULL AS accepted, reason FROM decided"""))
def q_admit(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    reqs = materialize_requests(_flawed_requests(spark, sf_dir))
    v = I.validate_requests(reqs, t.inventory, t.staff)
    return admit_orders(v, I.explode_order_lines(reqs), t.inventory).decisions


# Expiry runs between the requests: after so many order ids, with a cut-off date.
RUNS = [ExpiryRun(2500 * (i + 1), _dt.date(1996, 1, 1) + _dt.timedelta(300 * i)) for i in range(24)]
TIMELINE_SQL = f"""{_wants_sql(_FLAWED_SQL)},
  runs AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r.after_seq}, DATE '{r.as_of}')" for i, r in enumerate(RUNS))}) v(run, after_seq, as_of)),
  queued AS (SELECT seq, places, amounts, row_number() OVER (ORDER BY seq) AS idx FROM wants),
  returns AS (SELECT c.seq, min(r.run) AS run
              FROM checked c JOIN b_orders o ON o.order_id = c.src AND o.order_type = 'Collection' AND o.completed = 0
              JOIN b_collections k ON k.order_id = c.src
              JOIN runs r ON r.after_seq >= c.seq AND r.as_of >= k.collection_date + 8
              WHERE c.reason IS NULL GROUP BY c.seq),
  backs AS (SELECT run, list(struct_pack(idx := idx, place := place, amount := amount)) AS back
            FROM (SELECT t.run, q.idx, unnest(q.places) AS place, unnest(q.amounts) AS amount FROM queued q JOIN returns t USING (seq))
            GROUP BY run),
  nothing AS (SELECT []::STRUCT(idx BIGINT, place BIGINT, amount BIGINT)[] AS back),
  events AS (SELECT seq AS place_in_time, 0 AS kind, places, amounts, nothing.back FROM queued, nothing
             UNION ALL SELECT after_seq, 1 + run, []::BIGINT[], []::BIGINT[], coalesce(b.back, nothing.back)
             FROM runs LEFT JOIN backs b USING (run), nothing),
  folded AS (
    SELECT list_reduce(
      list_concat([(SELECT struct_pack(stock := list(stock ORDER BY place), places := []::BIGINT[], amounts := []::BIGINT[],
                                       accepted := []::BOOLEAN[], kind := 0,
                                       back := []::STRUCT(idx BIGINT, place BIGINT, amount BIGINT)[]) FROM shelf)],
                  list(struct_pack(stock := []::BIGINT[], places := places, amounts := amounts, accepted := []::BOOLEAN[],
                                   kind := kind, back := back) ORDER BY place_in_time, kind)),
      lambda acc, x: CASE
        WHEN x.kind > 0
        THEN struct_pack(stock := list_transform(acc.stock, lambda s, p: s + coalesce(list_sum(list_transform(
                                    list_filter(x.back, lambda b: b.place = p AND acc.accepted[b.idx]), lambda b: b.amount))::BIGINT, 0)),
                         places := []::BIGINT[], amounts := []::BIGINT[], accepted := acc.accepted, kind := 0, back := acc.back)
        WHEN list_bool_and(list_transform(x.places, lambda p, i: coalesce(acc.stock[p] >= x.amounts[i], true)))
        THEN struct_pack(stock := list_transform(acc.stock, lambda s, p: s - coalesce(x.amounts[list_position(x.places, p)], 0)),
                         places := []::BIGINT[], amounts := []::BIGINT[], accepted := list_append(acc.accepted, true),
                         kind := 0, back := acc.back)
        ELSE struct_pack(stock := acc.stock, places := []::BIGINT[], amounts := []::BIGINT[],
                         accepted := list_append(acc.accepted, false), kind := 0, back := acc.back) END) AS f
    FROM events),
  verdict AS (SELECT unnest((SELECT list(seq ORDER BY seq) FROM wants)) AS seq, unnest(f.accepted) AS fits FROM folded)"""


def _timeline(spark, sf_dir):
    t = bind_tables(spark, sf_dir)
    reqs = materialize_requests(_flawed_requests(spark, sf_dir))
    v = I.validate_requests(reqs, t.inventory, t.staff)
    # copies of an order with something wrong were not collected either
    done = t.orders.filter((F.col("order_type") == "Collection") & (F.col("completed") == 1)).select("order_id")
    collected = done.select(F.col("order_id").alias("seq")).unionByName(done.select((F.col("order_id") + FLAW_ID).alias("seq")))
    return admit_timeline(v, I.explode_order_lines(reqs), t.inventory, RUNS, collected)


@register("c3_timeline_admission", O.with_binding(f"""WITH {TIMELINE_SQL},
decided AS (SELECT c.seq, CASE WHEN c.reason IS NULL AND NOT v.fits THEN 'stock' ELSE c.reason END AS reason
            FROM checked c LEFT JOIN verdict v ON v.seq = c.seq)
SELECT d.seq, d.reason IS NULL AS accepted, d.reason, CASE WHEN d.reason IS NULL THEN r.as_of END AS cancelled_on
FROM decided d LEFT JOIN returns t ON t.seq = d.seq LEFT JOIN runs r ON r.run = t.run"""))
def q_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).decisions


@register("c3_timeline_stock", O.with_binding(f"""WITH {TIMELINE_SQL}
SELECT i.product_id, coalesce(left_.stock, CASE WHEN s.product_id IS NULL THEN i.stock END) AS stock
FROM b_inventory i LEFT JOIN shelf s USING (product_id)
LEFT JOIN (SELECT unnest(f.stock) AS stock, generate_subscripts(f.stock, 1) AS place FROM folded) left_ USING (place)"""))
def q_timeline_stock(spark, sf_dir):
    return _timeline(spark, sf_dir).inventory.select("product_id", "stock")


def _placed(spark, sf_dir):
    return place_orders(_no_orders(spark, bind_tables(spark, sf_dir)), _flawed_requests(spark, sf_dir), id_start=ID_START)


@register("c9_place_orders", O.with_binding(f"""WITH {FOLD_SQL}
SELECT seq, reason IS NULL AS accepted, reason, order_id FROM numbered"""))
def q_place(spark, sf_dir):
    return _placed(spark, sf_dir).decisions


@register("c9_order_lines_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT n.order_id, l.product_id, l.quantity FROM numbered n JOIN b_lines l ON l.order_id = n.src WHERE n.reason IS NULL"""))
def q_place_lines(spark, sf_dir):
    return _placed(spark, sf_dir).tables.order_products


# C4 and C6-C8 for the accepted orders, with stock, rejections and gaps in the ids.
@register("c9_orders_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT n.order_id, o.order_type, CAST(CASE WHEN o.order_type = 'InStore' THEN 1 ELSE 0 END AS INTEGER) AS completed, o.order_placed
FROM numbered n JOIN b_orders o ON o.order_id = n.src WHERE n.reason IS NULL"""))
def q_place_orders_rows(spark, sf_dir):
    return _placed(spark, sf_dir).tables.orders


@register("c9_staff_links_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT s.staff_id, n.order_id FROM numbered n JOIN b_sold_by s ON s.order_id = n.src WHERE n.reason IS NULL"""))
def q_place_links(spark, sf_dir):
    return _placed(spark, sf_dir).tables.staff_orders


@register("c9_collections_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT n.order_id, c.fname, c.lname, c.collection_date
FROM numbered n JOIN b_collections c ON c.order_id = n.src WHERE n.reason IS NULL"""))
def q_place_collections(spark, sf_dir):
    return _placed(spark, sf_dir).tables.collections


@register("c9_deliveries_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT n.order_id, d.fname, d.lname, d.house, d.street, d.city, d.delivery_date
FROM numbered n JOIN b_deliveries d ON d.order_id = n.src
WHERE n.reason IS NULL AND n.src NOT IN (SELECT order_id FROM b_collections)"""))
def q_place_deliveries(spark, sf_dir):
    return _placed(spark, sf_dir).tables.deliveries


@register("c9_stock_after", O.with_binding(f"""WITH {FOLD_SQL}
SELECT i.product_id, coalesce(left_.stock, CASE WHEN s.product_id IS NULL THEN i.stock END) AS stock
FROM b_inventory i LEFT JOIN shelf s USING (product_id)
LEFT JOIN (SELECT unnest(f.stock) AS stock, generate_subscripts(f.stock, 1) AS place FROM folded) left_ USING (place)"""))
def q_place_stock(spark, sf_dir):
    return _placed(spark, sf_dir).tables.inventory.select("product_id", "stock")


REPEAT_EVERY = 29   # requests that come again in the last file of the stream


@register("c11_stream_decisions", O.with_binding(f"""WITH {_fold_sql("")}
SELECT seq, reason IS NULL AS accepted, reason FROM decided
UNION ALL SELECT seq, false, 'seq' FROM decided WHERE seq % {REPEAT_EVERY} = 0"""))
def q_stream_decisions(spark, sf_dir):
    """Every request of the stream gets one decision; those that repeat an
    earlier file's ``seq`` are rejected."""
    base = f"{ensure_checkpoint_dir(spark)}/c11-{uuid.uuid4().hex}"
    reqs = materialize_requests(bind_requests(spark, sf_dir))
    publish(_no_orders(spark, bind_tables(spark, sf_dir)), f"{base}/ledger")
    for part in (reqs, reqs.filter(F.col("seq") % REPEAT_EVERY == 0)):
        part.write.mode("append").parquet(f"{base}/requests")
        stream_orders(spark, f"{base}/requests", f"{base}/ledger", f"{base}/checkpoint", fmt="parquet",
                      decisions_path=f"{base}/decisions").awaitTermination()
    return spark.read.parquet(f"{base}/decisions").select("seq", "accepted", "reason")


@register("c11_stream_orders", O.with_binding(f"""WITH {_fold_sql("")}
SELECT n.order_id, l.product_id, l.quantity FROM numbered n JOIN b_lines l ON l.order_id = n.src WHERE n.reason IS NULL"""))
def q_stream(spark, sf_dir):
    """The replayed requests arrive in three parts; the stream is started
    again for each and goes on from its checkpoint."""
    base = f"{ensure_checkpoint_dir(spark)}/c11-{uuid.uuid4().hex}"
    reqs = materialize_requests(bind_requests(spark, sf_dir))
    publish(_no_orders(spark, bind_tables(spark, sf_dir)), f"{base}/ledger")
    cuts = reqs.approxQuantile("seq", [1 / 3, 2 / 3], 0.01)
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("seq") > c).cast("int")
    for i in range(len(cuts) + 1):
        reqs.filter(part == i).write.mode("append").parquet(f"{base}/requests")
        stream = stream_orders(spark, f"{base}/requests", f"{base}/ledger", f"{base}/checkpoint", fmt="parquet",
                               id_start=ID_START if i == 0 else None)
        stream.awaitTermination()
    return read_version(spark, f"{base}/ledger").order_products


# ------------------------------------------------------------------ presentation
# The operators compute money exactly as DECIMAL(38,2).  Registered queries
# present it as whole pence (BIGINT, ``<name>_pence``), which reads the same
# through Row objects, DB-API tuples and pandas.
MONEY_COLUMNS = {
    "r1_sale_values": ("sale_value",),
    "r2_product_revenue": ("total_value",),
    "s9_view_product_revenue": ("total_value",),
    "s10_view_columns": ("lifetime_sales",),
    "r3_order_totals": ("order_total",),
    "r4_staff_lifetime_sales": ("lifetime_sales",),
    "r4_staff_lifetime_sales_compat": ("lifetime_sales",),
    "r5_top_products": ("total_value",),
    "r6_top_product_sellers": ("value_sold",),
    "r7_staff_by_top_value": ("total_value",),
    "r8_staff_product_units": ("total_value",),
    "r8_staff_product_crosstab": ("total_value",),
    "r9_yearly_top_products": ("total_value",),
    "r9_yearly_top_products_compat": ("total_value",),
    "r11_yearly_staff_sales": ("total_sales",),
    "r2_revenue_by_deltas": ("total_value",),
    "r9_yearly_top_by_deltas": ("total_value",),
    "r11_yearly_sales_by_deltas": ("total_sales",),
    "r11_yearly_staff_sales_compat": ("total_sales",),
    "d1_reduce_stock": ("price",),
    "d2_restock": ("price",),
    "e6_expire_collections_stock": ("price",),
}


def _present(name: str, cols: tuple[str, ...]) -> None:
    q = REGISTRY[name]

    def build(spark, sf_dir, _b=q.build):
        df = _b(spark, sf_dir)
        return df.select(*[(F.col(c) * 100).cast("bigint").alias(f"{c}_pence") if c in cols else F.col(c)
                           for c in df.columns])

    pence = ", ".join(f"CAST({c} * 100 AS BIGINT) AS {c}_pence" for c in cols)
    sql = f"SELECT * EXCLUDE ({', '.join(cols)}), {pence} FROM (\n{q.sql}\n) AS presented" if q.sql else None
    REGISTRY[name] = Query(build, sql)


for _name, _cols in MONEY_COLUMNS.items():
    _present(_name, _cols)
