"""A block of admission judged at once, and what the steps around it read."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterfoil.functions.dates import DEFAULT_REFERENCE_DATE as REFERENCE
from counterfoil.operators import blocks
from counterfoil.operators import intake as I
from counterfoil.operators.admission import admit_orders
from counterfoil.operators.timeline import ExpiryRun, admit_timeline
from counterfoil.plans import jobs
from counterfoil.sources.schemas import REQUESTS
from counterfoil.tables import Tables
from tests.fixtures import INVENTORY_A, REQUESTS_A, STAFF

LINES = pa.schema([(c, pa.string() if c == "st" else pa.int64()) for c in blocks._COLUMNS])
STARTS = pa.schema([(f"start_{c}", pa.int64()) for c in ("blk", "product_id", "place", "lo", "unsure", "later")])


def _table(rows, schema):
    return pa.table({c: [r[i] for r in rows] for i, c in enumerate(schema.names)}, schema=schema)


def _one_by_one(rows, starts):
    """Verdict of each order by its place: every line's bounds summed anew."""
    lo = {p: a for _, p, place, a, _, _ in starts if place is None}
    unsure = {p: o for _, p, place, _, o, _ in starts if place is None}
    verdict = {}
    for at in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == at]
        verdict[at] = mine[0][6]
        if verdict[at] != "O":
            continue
        low, high = [], []
        for _, _, p, q, stock, _, _ in mine:
            before = [(r[3], verdict[r[0]]) for r in rows if r[2] == p and r[0] < at and (r[5] is None or r[5] >= at)]
            given = [(a, o) for _, g, place, a, o, _ in starts if g == p and place is not None and place < at]
            a = lo[p] + sum(x for x, v in before if v == "A") + sum(a for a, _ in given)
            o = unsure[p] + sum(x for x, v in before if v == "O") + sum(o for _, o in given)
            low.append(a + q > stock)
            high.append(a + o + q <= stock)
        verdict[at] = "R" if any(low) else "A" if all(high) else "O"
    return verdict


@pytest.mark.parametrize("few", [1, 4, 64, 10**9])
def test_a_block_judged_at_once_equals_one_by_one(monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW", few)
    for seed in range(150):
        rnd = random.Random(seed)
        stock = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 9))]
        rows = []
        for i in range(rnd.randint(1, 40)):
            at = 2 * (100 + i)
            back = at + 1 + 2 * rnd.randint(0, 60) if rnd.random() < 0.4 else None
            st = "A" if rnd.random() < 0.2 else "O"
            rows += [(at, at + 1000, p, rnd.randint(1, 9), stock[p], back, st)
                     for p in rnd.sample(range(len(stock)), min(len(stock), rnd.randint(1, 3)))]
        starts = [(0, p, None, rnd.randint(0, 9), rnd.choice([3, 20]), rnd.choice([0, 5])) for p in {r[2] for r in rows}]
        starts += [(0, p, 2 * 100 + 1 + 2 * rnd.randint(0, 40), -rnd.randint(0, 9), -rnd.randint(0, 3), 0)
                   for p in range(len(stock) + 1) if rnd.random() < 0.5]
        rnd.shuffle(rows)
        want = _one_by_one(rows, starts)
        got = blocks._judge(_table(rows, LINES), _table(starts, STARTS)).to_pylist()
        assert {r["at"] for r in got if r["st"] == "R"} == {at for at, v in want.items() if v == "R"}
        left = [(r["at"], r["product_id"], r["qty"], r["back_at"]) for r in got if r["st"] == "O"]
        assert sorted(left, key=str) == sorted(((r[0], r[2], r[3], r[5]) for r in rows if want[r[0]] == "O"), key=str)
        # accepted quantity before an open line, less what has returned by then, is kept
        for at, p, *_ in left:
            use = lambda some: sum(q for place, q, back in some if place < at and (back is None or back >= at))
            assert use([(r["at"], r["qty"], r["back_at"]) for r in got if r["st"] == "A" and r["product_id"] == p]) \
                == use([(r[0], r[3], r[5]) for r in rows if want[r[0]] == "A" and r[2] == p])


def test_few_orders_of_a_block_go_on_one_by_one(monkeypatch):
    """Lines that nothing contests are judged all at once, whatever the block's size."""
    seen = []
    monkeypatch.setattr(blocks, "_chain_on", lambda new, *rest: seen.append(len(new)))
    rows = [(at, at, at % 700, 1, 10**6, None, "O") for at in range(50_000)]
    got = blocks._judge(_table(rows, LINES), _table([(0, p, None, 0, 0, 0) for p in range(700)], STARTS))
    assert got.num_rows == 0 and not seen


def test_lines_of_an_order_on_one_product_are_one():
    rows = [(5, 5, 1, 4, 7, None, "O"), (5, 5, 1, 4, 7, None, "O"), (6, 6, 1, 3, 7, None, "O"), (6, 6, 1, 4, 7, None, "O"),
            (7, 7, 2, 2, 9, 8, "O"), (7, 7, 2, 2, 9, 8, "O")]
    got = blocks._judge(_table(rows, LINES), _table([(0, 1, None, 0, 0, 5), (0, 2, None, 0, 6, 0)], STARTS)).to_pylist()
    assert sorted((r["at"], r["qty"], r["back_at"], r["st"]) for r in got if r["st"] != "R") == [(6, 7, None, "A"), (7, 4, 8, "O")]
    assert {r["seq"] for r in got if r["st"] == "R"} == {5}


def _requests(spark):
    t = Tables.from_rows(spark, inventory=INVENTORY_A, staff=STAFF[:2])
    return t, spark.createDataFrame(REQUESTS_A, REQUESTS)


def test_requests_are_not_dealt_out_to_be_validated(spark):
    t, requests = _requests(spark)
    plan = I.validate_requests(requests, t.inventory, t.staff.limit(2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(seq" not in plan


def test_a_batch_is_numbered_once(spark, monkeypatch):
    from counterfoil.operators import admission
    t, requests = _requests(spark)
    numbered, index = [], I.dense_index
    count = lambda df, *a: numbered.append(a) or index(df, *a)
    monkeypatch.setattr(I, "dense_index", count)
    monkeypatch.setattr(admission, "dense_index", count)
    placed = jobs.place_orders(t, requests, id_start=100)
    assert len(numbered) == 1
    assert {r.seq: r.order_id for r in placed.decisions.collect()}[7] == 106


def _counted(spark):
    """Validated requests that count how often a verdict is read."""
    t, requests = _requests(spark)
    read = spark.sparkContext.accumulator(0)
    look = F.udf(lambda reason: read.add(1) or reason, "string").asNondeterministic()
    validated = I.validate_requests(requests, t.inventory, t.staff)
    seen = spark.createDataFrame(validated.collect(), validated.schema).withColumn("reason", look("reason"))
    return seen, validated.count(), I.explode_order_lines(requests), t.inventory, read


def test_verdicts_are_read_once_by_admission(spark):
    seen, rows, lines, inventory, read = _counted(spark)
    assert len(admit_orders(seen, lines, inventory).decisions.collect()) == rows == read.value


def test_verdicts_are_read_once_in_the_timeline(spark):
    seen, rows, lines, inventory, read = _counted(spark)
    collected = spark.createDataFrame([(1,), (1,)], "seq long")
    got = admit_timeline(seen, lines, inventory, [ExpiryRun(3, REFERENCE)], collected).decisions.collect()
    assert read.value == rows == len(got)
