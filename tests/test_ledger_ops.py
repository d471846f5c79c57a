import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from counterfoil.functions.dates import parse_request_date
from counterfoil.operators import expiry as E
from counterfoil.operators import quality as V
from counterfoil.operators import stock as S
from counterfoil.operators.intake import explode_order_lines
from counterfoil.sources.publish import latest_version, publish, read_version
from counterfoil.sources.schemas import REQUESTS
from counterfoil.tables import Tables
from tests.fixtures import INVENTORY_G1, STAFF, g1, request


def test_parse_request_date(spark):
    cases = {"17-Nov-20": dt.date(2020, 11, 17), "17-nov-20": dt.date(2020, 11, 17),
             "7-Nov-20": dt.date(2020, 11, 7), "17-Nov-99": dt.date(1999, 11, 17),
             " 17-NOV-20 ": dt.date(2020, 11, 17),
             "32-Jan-20": None, "17-Nov-20xyz": None, "17-Nov-2020": None,
             "2020-11-17": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", parse_request_date("s").alias("d")).collect()}
    assert got == cases


def test_expired_orders_boundary(spark):
    t = g1(spark)
    assert E.expired_orders(t, "2020-05-27").count() == 0
    assert [r["order_id"] for r in E.expired_orders(t, "2020-05-28").collect()] == [2]


def test_expire_collections_g1(spark):
    t = g1(spark)
    res = E.expire_collections(t, dt.date(2020, 5, 28))
    after = res.tables
    assert [r[0] for r in res.cancelled.collect()] == [2]
    assert 2 not in {r["order_id"] for r in after.orders.collect()}
    assert 2 not in {r["order_id"] for r in after.order_products.collect()}
    assert 2 not in {r["order_id"] for r in after.collections.collect()}
    assert 2 not in {r["order_id"] for r in after.staff_orders.collect()}
    assert {r["product_id"]: r["stock"] for r in after.inventory.collect()}[2] == 600
    assert after.orders.count() == 5 and after.deliveries.count() == 1


def test_expiry_conserves_stock(spark):
    """stock + quantity on live lines is the same before and after."""
    t = g1(spark)

    def ledger(tt):
        live = tt.order_products.groupBy("product_id").agg(F.sum("quantity").alias("q"))
        return {r["product_id"]: r["stock"] + (r["q"] or 0)
                for r in tt.inventory.join(live, "product_id", "left").collect()}

    after = E.expire_collections(t, "2021-01-01").tables
    assert ledger(after) == ledger(t)


def test_delivery_row_blocks_expiry(spark):
    t = g1(spark)
    extra = spark.createDataFrame([(2, "X", "Y", "1", "S", "C", None)], t.deliveries.schema)
    t = t.replace(deliveries=t.deliveries.unionByName(extra))
    res = E.expire_collections(t, "2020-05-28")
    assert res.cancelled.count() == 0
    assert [r[0] for r in res.blocked.collect()] == [2]
    assert res.tables.orders.count() == 6
    # a later run date expires order 6 too; "skip" removes it, "abort" nothing
    skip = E.expire_collections(t, "2020-07-09")
    assert [r[0] for r in skip.cancelled.collect()] == [6]
    abort = E.expire_collections(t, "2020-07-09", on_blocked="abort")
    assert abort.cancelled.count() == 0 and abort.tables.orders.count() == 6
    assert {r["product_id"]: r["stock"] for r in abort.tables.inventory.collect()}[3] == 10


def test_remove_products_and_staff_cascade(spark):
    t = g1(spark)
    gone = spark.createDataFrame([(2,)], "product_id long")
    after = E.remove_products(t, gone)
    assert 2 not in {r[0] for r in after.order_products.select("product_id").collect()}
    assert after.inventory.count() == 3
    after = E.remove_staff(t, spark.createDataFrame([(1,)], "staff_id long"))
    assert {r["staff_id"] for r in after.staff_orders.collect()} == {2}


def test_stock_ops(spark):
    t = g1(spark)
    lines = spark.createDataFrame([(9, 1, 10), (9, 1, 5), (9, 3, 1)], t.order_products.schema)
    inv = {r["product_id"]: r["stock"] for r in S.reduce_stock(t.inventory, lines).collect()}
    assert inv == {1: 985, 2: 500, 3: 9, 4: 5}
    back = S.restock(S.reduce_stock(t.inventory, lines), lines)
    assert {r["product_id"]: r["stock"] for r in back.collect()} == {1: 1000, 2: 500, 3: 10, 4: 5}
    nul = t.inventory.withColumn("stock", F.lit(None).cast("long"))
    assert {r["stock"] for r in S.reduce_stock(nul, lines).collect()} == {None}
    flags = {(r["product_id"], r["quantity"]): r["sufficient"]
             for r in S.sufficient_stock(
                 spark.createDataFrame([(1, 3, 10), (1, 3, 11), (1, 99, 1)], t.order_products.schema),
                 t.inventory).collect()}
    assert flags == {(3, 10): True, (3, 11): False, (99, 1): None}


def test_stock_levels_keep_request_order(spark):
    t = g1(spark)
    req = spark.createDataFrame([request(1, [(3, 1), (1, 1), (3, 2), (99, 1)], 1)], REQUESTS)
    out = [(r["product_id"], r["stock"])
           for r in S.stock_levels(t.inventory, explode_order_lines(req)).collect()]
    assert out == [(3, 10), (1, 1000), (3, 10), (99, None)]


def test_fulfilment_type(spark):
    t = g1(spark)
    stored = t.orders.withColumn("order_type", F.lit("InStore"))
    got = {r["order_id"]: r["order_type"]
           for r in S.fulfilment_type(stored, t.collections, t.deliveries).collect()}
    assert got == {1: "InStore", 2: "Collection", 3: "Delivery", 4: "InStore",
                   5: "Collection", 6: "Collection"}


def test_integrity_rules(spark):
    inv = INVENTORY_G1 + [(1, "Dup", D("1.00"), 1), (7, None, D("1.00"), 1),
                          (8, "x" * 31, D("999999.99"), 1)]
    t = Tables.from_rows(
        spark, inventory=[], staff=STAFF,
        orders=[(1, "InStore", 1, dt.date(2020, 1, 2)), (2, "Post", 2, None),
                (3, "Collection", 0, dt.date(2020, 1, 5))],
        order_products=[(1, 1, 0), (1, 2, -1), (42, 1, 1)],
        collections=[(3, "A", "B", dt.date(2020, 1, 4))],
        staff_orders=[(1, 1)])
    # NULL product_desc needs a nullable schema for the fixture row
    loose = t.inventory.schema
    loose = type(loose)([f.__class__(f.name, f.dataType, True) for f in loose.fields])
    t = t.replace(inventory=spark.createDataFrame(inv, loose))
    found = {(r["rule"], r["table_name"], r["row_key"]) for r in V.validate_tables(t).collect()}
    assert ("V1", "inventory", "1") in found
    assert ("V2", "order_products", "42") in found
    assert ("V3", "orders", "2") in found and ("V4", "orders", "2") in found
    assert ("V5", "inventory", "7") in found
    assert ("V6", "order_products", "1|1") in found and ("V6", "order_products", "1|2") in found
    assert ("V7", "collections", "3") in found
    assert ("V8", "inventory", "8") in found
    valid, rejected = V.split_valid(t.inventory, V.validate_tables(t), "inventory", ["product_id"])
    assert {r["product_id"] for r in rejected.collect()} == {1, 7, 8}


def test_publish_is_all_or_nothing(spark, scratch):
    t = g1(spark)
    root = f"{scratch}/ledger"
    assert latest_version(spark, root) == 0
    v1 = publish(t, root, job_id="batch-1")
    assert v1 == 1 and publish(t, root, job_id="batch-1") == 1      # replay: no new version
    # a half-written version (no commit marker) is invisible
    t.orders.write.parquet(f"{root}/v00000002/orders")
    assert latest_version(spark, root) == 1
    back = read_version(spark, root)
    types = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    assert back.orders.count() == 6 and types(back.inventory) == types(t.inventory)


def test_year_filter_and_columns_reach_the_scan(spark, scratch):
    """On stored ledger tables a single-year report reads the orders file
    with the date range pushed down and only the columns it needs."""
    from counterfoil.operators import reports as R
    from counterfoil.tables import Tables
    root = f"{scratch}/ledger"
    publish(g1(spark), root)
    t = read_version(spark, root)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # untruncated filter lists
    plan = R.employees_of_the_year(t, 2020)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln and "/orders]" in ln]
    assert scans
    for ln in scans:
        assert "GreaterThanOrEqual(order_placed,2020-01-01)" in ln
        assert "LessThan(order_placed,2021-01-01)" in ln
        assert "order_type" not in ln.split("ReadSchema:")[1]


def test_expiry_cutoff_reaches_the_scan(spark, scratch):
    root = f"{scratch}/ledger"
    publish(g1(spark), root)
    t = read_version(spark, root)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = E.expired_orders(t, "2020-05-28")._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln and "/collections]" in ln]
    assert scans and all("LessThanOrEqual(collection_date,2020-05-20)" in ln for ln in scans)
    assert [r["order_id"] for r in E.expired_orders(t, "2020-05-28").collect()] == [2]


def test_read_raw_csv_requests(spark, scratch):
    from counterfoil.sources.files import read_requests
    path = f"{scratch}/requests.csv"
    with open(path, "w") as fh:
        fh.write("seq,order_type,products,quantities,sale_date,due_date,fname,lname,house,street,city,staff_id\n")
        fh.write(" 7 ,InStore,1;3, 2 ;1,17-Nov-20,,,,,,, 2\n")
        fh.write("8,Collection,2,x,17-nov-20,20-Nov-20,Al,Bo,,,,1\n")
    got = {r["seq"]: r for r in read_requests(spark, path, fmt="csv", raw=True).collect()}
    assert got[7]["products"] == [1, 3] and got[7]["quantities"] == [2, 1] and got[7]["staff_id"] == 2
    assert got[8]["quantities"] == [None] and got[8]["fname"] == "Al"


def test_expiry_does_not_sort_the_lines(spark):
    """A task holds the removed ids of its partition, not its order lines."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = E.expire_collections(g1(spark), "2020-06-10").tables
        for df, kind in ((after.order_products, "LeftAnti"), (after.inventory, "LeftSemi")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert any("ShuffledHashJoin" in line and kind in line for line in plan.splitlines())
        assert sorted(r.order_id for r in after.order_products.collect()) == [1, 3, 4, 5, 6]
        assert {r.product_id: r.stock for r in after.inventory.collect()}[2] == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
