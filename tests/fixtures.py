"""Hand-made fixtures (FIXTURES.md §2)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from counterfoil.tables import Tables

INVENTORY_G1 = [(1, "Widget", D("100.00"), 1000), (2, "Gizmo", D("250.50"), 500),
                (3, "Bolt", D("0.99"), 10), (4, "Unsold", D("5.00"), 5)]
STAFF = [(1, "Ada", "Li"), (2, "Bo", "Ray"), (3, "Cy", "Dee")]

# order, type, completed, placed, staff, [(product, qty)], due
ORDERS_G1 = [
    (1, "InStore", 1, date(2020, 3, 1), 1, [(1, 250)], None),
    (2, "Collection", 0, date(2020, 5, 10), 1, [(2, 100)], date(2020, 5, 20)),
    (3, "Delivery", 0, date(2020, 6, 1), 2, [(1, 300)], date(2020, 6, 5)),
    (4, "InStore", 1, date(2019, 7, 1), 2, [(2, 90)], None),
    (5, "Collection", 1, date(2020, 5, 10), 2, [(3, 5)], date(2020, 5, 20)),
    (6, "Collection", 0, date(2020, 6, 20), 2, [(3, 2)], date(2020, 7, 1)),
]
ORDER_G2 = (7, "InStore", 1, date(2019, 8, 1), 3, [(2, 140)], None)


def ledger(spark, orders, extra_links=()) -> Tables:
    rows = dict(inventory=INVENTORY_G1, staff=STAFF, orders=[], order_products=[],
                staff_orders=[], collections=[], deliveries=[])
    for oid, kind, done, placed, staff, lines, due in orders:
        rows["orders"].append((oid, kind, done, placed))
        rows["staff_orders"].append((staff, oid))
        rows["order_products"] += [(oid, p, q) for p, q in lines]
        if kind == "Collection":
            rows["collections"].append((oid, "Cal", "Lector", due))
        elif kind == "Delivery":
            rows["deliveries"].append((oid, "Del", "Iver", "1", "High St", "Leeds", due))
    rows["staff_orders"] += list(extra_links)
    return Tables.from_rows(spark, **rows)


def g1(spark):
    return ledger(spark, ORDERS_G1)


def g2(spark):
    return ledger(spark, ORDERS_G1 + [ORDER_G2])


def fanout(spark):
    """F: G1 with staff 2 also linked to order 1."""
    return ledger(spark, ORDERS_G1, extra_links=[(2, 1)])


def request(seq, lines, staff, kind="InStore", sale="17-Nov-20", due=None,
            fname=None, lname=None, house=None, street=None, city=None,
            products=None, quantities=None):
    return (seq, kind,
            products if products is not None else [p for p, _ in lines],
            quantities if quantities is not None else [q for _, q in lines],
            sale, due, fname, lname, house, street, city, staff)


# A: admission; stock 1 = 10, 2 = 5, 5 = NULL; staff 1 and 2.
INVENTORY_A = [(1, "One", D("1.00"), 10), (2, "Two", D("2.00"), 5), (5, "Five", D("5.00"), None)]
REQUESTS_A = [
    request(1, [(1, 10), (2, 6)], 1),
    request(2, [(1, 10)], 1),
    request(3, [(1, 1)], 2),
    request(4, [(2, 3), (2, 2)], 2),
    request(5, [(99, 1)], 1),
    request(6, [(2, 1)], 9),
    request(7, [(5, 7)], 1),
]
EXPECTED_A = {1: "stock", 2: None, 3: "stock", 4: None, 5: "product", 6: "staff", 7: None}
