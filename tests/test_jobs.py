import os
from decimal import Decimal as D

import pytest

from counterfoil.plans.jobs import run_expiry, run_placement
from counterfoil.sources.publish import commit_note, committed_versions, publish, publish_changes, read_version
from counterfoil.sources.schemas import REQUESTS
from counterfoil.streaming.orders_stream import place_batch
from counterfoil.tables import Tables
from tests.fixtures import STAFF, request


def _shop(spark):
    return Tables.from_rows(spark, inventory=[(1, "One", D("1.00"), 10)], staff=STAFF)


def test_replayed_batch_id_publishes_once(spark, scratch):
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    batch = spark.createDataFrame([request(1, [(1, 4)], 1)], REQUESTS)
    v1 = place_batch(spark, batch, 0, root, "s")
    v2 = place_batch(spark, batch, 0, root, "s")      # the same micro-batch re-run after a failure
    assert v1 == v2 == 2 and committed_versions(spark, root) == [1, 2]
    stock = {r["product_id"]: r["stock"] for r in read_version(spark, root).inventory.collect()}
    assert stock == {1: 6}


def test_expiry_returns_stock_to_later_orders(spark, scratch):
    """Placement, expiry and placement applied in time order, each on the
    version the previous one published."""
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    first = spark.createDataFrame([request(1, [(1, 8)], 1, kind="Collection", sale="01-Mar-20",
                                           due="02-Mar-20", fname="A", lname="B")], REQUESTS)
    _, placed = run_placement(read_version(spark, root), first, root, job_id="p1")
    assert [r["accepted"] for r in placed.decisions.collect()] == [True]

    late = spark.createDataFrame([request(2, [(1, 5)], 2, sale="20-Mar-20")], REQUESTS)
    _, refused = run_placement(read_version(spark, root), late, root, job_id="p2")
    assert [r["reason"] for r in refused.decisions.collect()] == ["stock"]   # 2 left, 5 wanted

    _, expired = run_expiry(read_version(spark, root), "2020-03-10", root, job_id="e1")
    assert [r[0] for r in expired.cancelled.collect()] == [1]
    assert {r["stock"] for r in read_version(spark, root).inventory.collect()} == {10}

    again = spark.createDataFrame([request(3, [(1, 5)], 2, sale="20-Mar-20")], REQUESTS)
    _, accepted = run_placement(read_version(spark, root), again, root, job_id="p3")
    assert [r["accepted"] for r in accepted.decisions.collect()] == [True]
    final = read_version(spark, root)
    assert {r["stock"] for r in final.inventory.collect()} == {5}
    # ids 1 (cancelled) and 2 (rejected) are not handed out again
    assert [r["order_id"] for r in final.orders.collect()] == [3]
    assert committed_versions(spark, root) == [1, 2, 3, 4, 5]


def _files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names}


def test_placement_writes_only_new_rows_and_stock(spark, scratch):
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    batch = spark.createDataFrame([request(1, [(1, 4)], 1)], REQUESTS)
    run_placement(read_version(spark, root), batch, root)
    before = _files(root)
    more = spark.createDataFrame([request(2, [(1, 1)], 1), request(3, [(1, 9)], 1)], REQUESTS)
    run_placement(read_version(spark, root), more, root)
    after = _files(root)
    assert before.items() <= after.items()      # nothing published is written again
    note = commit_note(spark, root, 3)
    assert note["next_order_id"] == 4 and "staff" not in note["tables"]
    assert spark.read.parquet(f"{root}/attempts/{note['attempt']}/orders").count() == 1
    t = read_version(spark, root)
    assert sorted(r["order_id"] for r in t.orders.collect()) == [1, 2]
    assert [r["stock"] for r in t.inventory.collect()] == [5]
    assert [r["stock"] for r in read_version(spark, root, 2).inventory.collect()] == [6]


def test_half_written_commits_are_invisible(spark, scratch):
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    os.makedirs(f"{root}/attempts/dead/orders/_temporary")
    with open(f"{root}/commits/.half", "w") as f:
        f.write('{"attempt": "dea')
    assert committed_versions(spark, root) == [1] and read_version(spark, root).inventory.count() == 1


def test_second_writer_of_a_version_fails(spark, scratch):
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    batch = spark.createDataFrame([request(1, [(1, 4)], 1)], REQUESTS)
    run_placement(read_version(spark, root), batch, root)
    kept = _files(root)
    with pytest.raises(Exception, match="already committed"):
        publish_changes(spark, root, {"inventory": _shop(spark).inventory}, version=2)
    assert kept.items() <= _files(root).items() and committed_versions(spark, root) == [1, 2]
    assert [r["stock"] for r in read_version(spark, root).inventory.collect()] == [6]


def test_snapshot_compacts(spark, scratch):
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    run_placement(read_version(spark, root), spark.createDataFrame([request(1, [(1, 4)], 1)], REQUESTS), root)
    publish(read_version(spark, root), root, {"next_order_id": 2})
    t = read_version(spark, root)
    assert t.orders.count() == 1 and [r["stock"] for r in t.inventory.collect()] == [6]


def test_second_placement_from_a_stale_read_fails(spark, scratch):
    """Two placements of 6 of a stock of 10, given the same tables: the second commits nothing."""
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    t = read_version(spark, root)
    assert t.version == 1
    run_placement(t, spark.createDataFrame([request(1, [(1, 6)], 1)], REQUESTS), root)
    with pytest.raises(FileExistsError, match="already committed"):
        run_placement(t, spark.createDataFrame([request(2, [(1, 6)], 1)], REQUESTS), root)
    with pytest.raises(FileExistsError, match="already committed"):
        run_expiry(t, "2030-01-01", root)
    now = read_version(spark, root)
    assert committed_versions(spark, root) == [1, 2] and now.version == 2
    assert [r["quantity"] for r in now.order_products.collect()] == [6]
    assert [r["stock"] for r in now.inventory.collect()] == [4]
    _, refused = run_placement(now, spark.createDataFrame([request(2, [(1, 6)], 1)], REQUESTS), root)
    assert [r["reason"] for r in refused.decisions.collect()] == ["stock"]


def test_batch_is_placed_again_when_the_ledger_moved_on(spark, scratch, monkeypatch):
    from counterfoil.streaming import orders_stream
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)

    def read_then_lose(spark, root):
        t = read_version(spark, root)
        if t.version == 1:
            run_placement(t, spark.createDataFrame([request(9, [(1, 7)], 1)], REQUESTS), root)
        return t
    monkeypatch.setattr(orders_stream, "read_version", read_then_lose)
    batch = spark.createDataFrame([request(1, [(1, 6)], 1), request(2, [(1, 3)], 1)], REQUESTS)
    assert place_batch(spark, batch, 0, root, "s", f"{scratch}/decisions") == 3
    got = {r["seq"]: r["reason"] for r in spark.read.parquet(f"{scratch}/decisions").collect()}
    assert got == {1: "stock", 2: None}
    assert [r["stock"] for r in read_version(spark, root).inventory.collect()] == [0]


def test_newest_marker_knows_every_stream(spark, scratch):
    from counterfoil.sources.publish import last_batch
    root = f"{scratch}/ledger"
    publish(_shop(spark), root)
    one = spark.createDataFrame([request(1, [(1, 1)], 1)], REQUESTS)
    place_batch(spark, one, 0, root, "a")
    place_batch(spark, one, 4, root, "b")
    publish(read_version(spark, root), root, {"next_order_id": 3})       # a snapshot carries them on
    assert (last_batch(spark, root, "a"), last_batch(spark, root, "b")) == ((0, 2), (4, 3))
    assert last_batch(spark, root, "c") is None
    assert place_batch(spark, one, 4, root, "b") == 3 and committed_versions(spark, root) == [1, 2, 3, 4]
