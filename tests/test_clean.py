"""Cascading rejects, and request lines in quarantine."""

import json
import os
from datetime import date
from decimal import Decimal as D

from counterfoil.operators.quality import CASCADE, clean_tables, parents_first, validate_tables
from counterfoil.sources.files import read_requests_checked
from counterfoil.sources.publish import publish, read_version
from counterfoil.sources.schemas import REQUESTS
from counterfoil.streaming.orders_stream import stream_orders
from counterfoil.tables import Tables
from tests.fixtures import STAFF, request

FIELDS = [f.name for f in REQUESTS.fields]


def test_rejects_run_down_the_foreign_keys(spark):
    day = date(2020, 1, 2)
    t = Tables.from_rows(
        spark, inventory=[(1, "a", D("1.00"), 1), (2, None, D("1.00"), 1), (3, "c", D("1.00"), 1), (3, "c", D("1.00"), 1)],
        staff=[(1, "A", "B"), (2, "x" * 31, "B")],
        orders=[(1, "InStore", 1, day), (2, "Post", 0, day), (3, "Collection", 0, day), (4, "Delivery", 0, None)],
        order_products=[(1, 1, 5), (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1), (9, 1, 1), (3, 1, 2)],
        collections=[(3, "A", "B", date(2020, 1, 1)), (3, "A", "B", None), (2, "A", "B", day)],
        deliveries=[(4, "A", "B", "1", "s", "c", day), (2, "A", "B", "1", "s", "c", date(2019, 1, 1))],
        staff_orders=[(1, 1), (2, 1), (2, 2), (1, 2), (7, 3)])
    got = clean_tables(t, lambda df: df.checkpoint(eager=True))
    rejects = sorted((r.table_name, r.row_key, tuple(r.reasons)) for r in got.rejects.collect())
    assert rejects == sorted([
        ("inventory", "2", ("V5",)), ("inventory", "3", ("V1",)), ("inventory", "3", ("V1",)), ("staff", "2", ("V8",)),
        ("orders", "2", ("V3",)), ("order_products", "1|1", ("V6",)), ("order_products", "1|2", (CASCADE,)),
        ("order_products", "1|3", (CASCADE,)), ("order_products", "2|1", (CASCADE,)), ("order_products", "9|1", ("V2",)),
        ("collections", "3", ("V7",)), ("collections", "2", (CASCADE,)), ("deliveries", "2", ("V7", CASCADE)),
        ("staff_orders", "2|1", (CASCADE,)), ("staff_orders", "2|2", (CASCADE,)), ("staff_orders", "1|2", (CASCADE,)),
        ("staff_orders", "7|3", ("V2",))])
    assert validate_tables(got.tables).collect() == []
    assert {n: df.count() for n, df in got.tables.items()} == {
        "inventory": 1, "orders": 3, "order_products": 2, "deliveries": 1, "collections": 1, "staff": 1, "staff_orders": 1}


def test_parents_come_first():
    order = parents_first()
    assert sorted(order) == sorted(Tables.__dataclass_fields__.keys() - {"version"})
    assert all(order.index(p) < order.index(c) for p in ("orders", "inventory") for c in ("order_products",))


def _line(*args, **kwargs):
    return json.dumps(dict(zip(FIELDS, request(*args, **kwargs))))


BROKEN_LINES = ['{"seq": 7, "order_type": "InS', "no json at all", '[1, 2]', '{"seq": "eight", "products": [1]}',
                '{"seq": 9, "products": 5, "quantities": ["a"]}']
REASONS = {BROKEN_LINES[0]: "not json", BROKEN_LINES[1]: "not json", BROKEN_LINES[2]: "not json",
           BROKEN_LINES[3]: "type of seq", BROKEN_LINES[4]: "type of products, quantities"}


def test_broken_lines_are_kept_with_their_text(spark, scratch):
    good = [_line(1, [(1, 2)], 1), _line(2, [(1, 3)], 1), '{"seq": 3}', '{"unknown": 1}']
    for i in range(2):
        with open(f"{scratch}/{i}.json", "w") as f:
            f.write("\n".join(good[i::2] + BROKEN_LINES[i::2] + ["", "  "]) + "\n")
    got = read_requests_checked(spark, scratch, lambda df: df.checkpoint(eager=True))
    assert sorted(r.seq or 0 for r in got.requests.collect()) == [0, 1, 2, 3]
    assert got.requests.schema.fieldNames() == FIELDS
    broken = got.quarantine.collect()
    assert {r.text: r.reason for r in broken} == REASONS and len(broken) == len(BROKEN_LINES)
    assert {os.path.basename(r.file) for r in broken} == {"0.json", "1.json"}


def test_stream_puts_broken_lines_aside(spark, scratch):
    root, src = f"{scratch}/ledger", f"{scratch}/requests"
    publish(Tables.from_rows(spark, inventory=[(1, "One", D("1.00"), 10)], staff=STAFF), root)
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        f.write("\n".join([_line(1, [(1, 4)], 1), BROKEN_LINES[0], _line(2, [(1, 7)], 1), BROKEN_LINES[4]]) + "\n")
    stream_orders(spark, src, root, f"{scratch}/cp", decisions_path=f"{scratch}/decisions",
                  quarantine_path=f"{scratch}/broken").awaitTermination(200)
    assert {r.text: r.reason for r in spark.read.parquet(f"{scratch}/broken").collect()} == {
        t: REASONS[t] for t in (BROKEN_LINES[0], BROKEN_LINES[4])}
    assert {r.seq: r.reason for r in spark.read.parquet(f"{scratch}/decisions").collect()} == {1: None, 2: "stock"}
    assert [r.stock for r in read_version(spark, root).inventory.collect()] == [6]
