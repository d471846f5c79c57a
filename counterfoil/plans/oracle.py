"""Oracle SQL (DuckDB dialect) for the registered queries.

The driver registers the source tables (part, orders, lineitem, customer,
nation, region, ...) as views.  ``binding(staff_by)`` restates the rules of
``counterfoil.sources.testdata`` as CTEs named ``b_<table>``; each query
below is written against those CTEs as plain SQL, independently of the
DataFrame code it checks.  Money is cast to DECIMAL(38,2), counts and unit
sums to BIGINT, years to INTEGER, matching the Spark types.
"""

from __future__ import annotations


def binding(staff_by: str = "nation") -> str:
    if staff_by == "nation":
        staff = """
  b_staff AS (SELECT CAST(n_nationkey AS BIGINT) AS staff_id,
                     split_part(n_name, '_', 1) AS fname, split_part(n_name, '_', 2) AS lname
              FROM nation),
  b_sold_by AS (SELECT CAST(c.c_nationkey AS BIGINT) AS staff_id, CAST(o.o_orderkey AS BIGINT) AS order_id
                FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
  b_helpers AS (SELECT (staff_id + 1) % 25 AS staff_id, order_id FROM b_sold_by WHERE order_id % 7 = 0)"""
    elif staff_by == "region":
        staff = """
  b_staff AS (SELECT CAST(r_regionkey AS BIGINT) AS staff_id,
                     split_part(r_name, ' ', 1) AS fname, split_part(r_name, ' ', 2) AS lname
              FROM region),
  b_sold_by AS (SELECT CAST(n.n_regionkey AS BIGINT) AS staff_id, CAST(o.o_orderkey AS BIGINT) AS order_id
                FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
                JOIN nation n ON n.n_nationkey = c.c_nationkey),
  b_helpers AS (SELECT (staff_id + 1) % 5 AS staff_id, order_id FROM b_sold_by WHERE order_id % 7 = 0)"""
    elif staff_by == "customer":
        staff = """
  b_staff AS (SELECT CAST(c_custkey AS BIGINT) AS staff_id,
                     split_part(c_name, '#', 1) AS fname, split_part(c_name, '#', 2) AS lname
              FROM customer),
  b_sold_by AS (SELECT CAST(c.c_custkey AS BIGINT) AS staff_id, CAST(o.o_orderkey AS BIGINT) AS order_id
                FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
  b_helpers AS (SELECT staff_id + 1 AS staff_id, order_id FROM b_sold_by
                WHERE order_id % 7 = 0 AND staff_id + 1 IN (SELECT c_custkey FROM customer))"""
    else:
        raise ValueError(staff_by)
    return f"""
  b_inventory AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_name AS product_desc,
                         CAST(p_retailprice AS DECIMAL(8,2)) AS price,
                         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_size AS BIGINT) * 20 END AS stock
                  FROM part
                  UNION ALL
                  SELECT CAST(p_partkey AS BIGINT) + 1000000000, 'spare ' || p_name, CAST(p_retailprice AS DECIMAL(8,2)),
                         CAST(p_size AS BIGINT) * 20
                  FROM part WHERE p_partkey % 101 = 0),
  b_typed AS (SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_custkey AS BIGINT) AS cust_id,
                     CASE substr(o_orderpriority, 1, 1)
                          WHEN '1' THEN 'InStore' WHEN '2' THEN 'InStore'
                          WHEN '3' THEN 'Collection' WHEN '4' THEN 'Collection'
                          WHEN '5' THEN 'Delivery' END AS order_type,
                     o_orderstatus AS status, CAST(o_orderdate AS DATE) AS order_placed
              FROM orders),
  b_orders AS (SELECT order_id, order_type,
                      CAST(CASE WHEN order_type = 'InStore' OR status = 'F' THEN 1 ELSE 0 END AS INTEGER) AS completed,
                      order_placed
               FROM b_typed),
  b_lines AS (SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_partkey AS BIGINT) AS product_id,
                     CAST(l_quantity AS INTEGER) AS quantity
              FROM lineitem),
  b_collections AS (SELECT t.order_id, split_part(c.c_name, '#', 1) AS fname, split_part(c.c_name, '#', 2) AS lname,
                           CAST(t.order_placed + CAST(1 + t.order_id % 14 AS INTEGER) AS DATE) AS collection_date
                    FROM b_typed t JOIN customer c ON c.c_custkey = t.cust_id
                    WHERE t.order_type = 'Collection'),
  b_deliveries AS (SELECT t.order_id, split_part(c.c_name, '#', 1) AS fname, split_part(c.c_name, '#', 2) AS lname,
                          CAST(c.c_custkey AS VARCHAR) AS house, c.c_mktsegment AS street, n.n_name AS city,
                          CAST(t.order_placed + CAST(1 + t.order_id % 14 AS INTEGER) AS DATE) AS delivery_date
                   FROM b_typed t JOIN customer c ON c.c_custkey = t.cust_id
                   JOIN nation n ON n.n_nationkey = c.c_nationkey
                   WHERE t.order_type = 'Delivery' OR (t.order_type = 'Collection' AND t.order_id % 11 = 0)),{staff},
  b_staff_orders AS (SELECT staff_id, order_id FROM b_sold_by UNION ALL SELECT staff_id, order_id FROM b_helpers)"""


def with_binding(body: str, staff_by: str = "nation") -> str:
    """Prefix ``body`` (which starts with further CTEs or a SELECT) with
    the binding CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH" + binding(staff_by) + ",\n" + body[5:]
    return "WITH" + binding(staff_by) + "\n" + body


# Shared fragments ---------------------------------------------------------

# Value of each product: its priced lines, and 0 for the products without any.
REVENUE = """
  sold_value AS (SELECT product_id, SUM(quantity * price) AS total_value
                 FROM b_lines JOIN b_inventory USING (product_id) GROUP BY product_id),
  revenue AS (SELECT * FROM sold_value
              UNION ALL
              SELECT product_id, 0 FROM b_inventory WHERE product_id NOT IN (SELECT product_id FROM b_lines))"""

# Orders with a staff row: year and weight (1 strict, k compat).
LINKED = """
  linked AS (SELECT o.order_id, CAST(year(o.order_placed) AS INTEGER) AS yr,
                    {weight} AS w
             FROM b_orders o JOIN (SELECT order_id, COUNT(*) AS k FROM b_staff_orders GROUP BY order_id) s
               ON s.order_id = o.order_id)"""

ORDER_TOTALS = """
  totals AS (SELECT l.order_id, k.yr, SUM(l.quantity * i.price * k.w) AS order_total
             FROM b_lines l JOIN b_inventory i ON i.product_id = l.product_id
             JOIN linked k ON k.order_id = l.order_id
             GROUP BY l.order_id, k.yr)"""


def linked(mode: str) -> str:
    return LINKED.format(weight="CAST(1 AS BIGINT)" if mode == "strict" else "s.k")
