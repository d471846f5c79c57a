import random
from datetime import date
from decimal import Decimal as D

from counterfoil.operators.arrivals import check_arrivals, key_ranges, known_keys, unknown_in_requests
from counterfoil.operators.quality import validate_tables
from counterfoil.tables import Tables
from tests.fixtures import STAFF
from tests.test_layout import _plan


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_batch_violations_equal_a_full_check(spark):
    rnd = random.Random(2)
    day = date(2020, 1, 1)
    old = Tables.from_rows(
        spark, inventory=[(p, "p", D("1.00"), 1) for p in range(1, 40)], staff=STAFF,
        orders=[(i, "InStore", 1, day) for i in range(0, 900, 3)])
    new = dict(orders=[(i, "InStore", 1, day) for i in (3, 900, 901, 901, 5000, 7)],
               order_products=[(rnd.choice([0, 1, 3, 900, 901, 999, 5000, -4]), rnd.choice([1, 20, 39, 40, 77]), 1) for _ in range(60)],
               staff_orders=[(rnd.choice([1, 2, 9]), rnd.choice([6, 7, 8, 901])) for _ in range(20)],
               collections=[(6, "A", "B", day), (8, "A", "B", day)], deliveries=[])
    batch = {n: getattr(Tables.from_rows(spark, **new), n) for n in new}
    got = check_arrivals(batch, old).select("rule", "table_name", "row_key")
    both = old.replace(**{n: getattr(old, n).unionByName(df) for n, df in batch.items()})
    full = validate_tables(both).filter("rule in ('V1', 'V2')").select("rule", "table_name", "row_key")
    assert _rows(got) == _rows(full) and got.count() > 20
    empty = {n: df.limit(0) for n, df in batch.items()}
    assert check_arrivals(empty, old).count() == 0


def test_ranges_hold_every_key(spark):
    keys = [5, 6, 7, 10 ** 18, 10 ** 18 + 3, -(10 ** 18), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    spans = key_ranges(df, "k", 8)
    assert len(spans) <= 8 and all(any(a <= k <= b for a, b in spans) for k in keys if k is not None)
    assert key_ranges(df.filter("k is null"), "k") == []


def test_little_of_the_parent_is_read(spark, scratch):
    """A parent stored in key order: only row groups with a key of the batch are read."""
    (spark.range(2_000_000).withColumnRenamed("id", "order_id").repartitionByRange(8, "order_id").sortWithinPartitions("order_id")
     .write.option("parquet.block.size", 128 * 1024).parquet(f"{scratch}/orders"))
    parent = spark.read.parquet(f"{scratch}/orders")
    batch = spark.createDataFrame([(k,) for k in [17, 1_999_000, 1_999_001, 5_000_000]], "order_id long")
    known = known_keys(parent, "order_id", batch, "order_id")
    assert sorted(r[0] for r in known.collect()) == [17, 1_999_000, 1_999_001]
    read = [p.metrics().get("numOutputRows").get().value() for name, p in _plan(known) if name == "FileSourceScanExec"]
    assert sum(read) < 2_000_000 / 10


def test_unknown_names_in_requests(spark):
    ledger = Tables.from_rows(spark, inventory=[(1, "a", D("1.00"), 1)], staff=STAFF)
    lines = spark.createDataFrame([(1, 1), (2, 9), (3, 1), (4, None), (5, 9)], "seq long, product_id long")
    requests = spark.createDataFrame([(1, 1), (2, 1), (3, 8), (4, 1), (5, None)], "seq long, staff_id long")
    got = {r.seq: r.reason for r in unknown_in_requests(lines, requests, ledger).collect()}
    assert got == {2: "product", 3: "staff", 4: "product", 5: "product"}
