import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from counterfoil.functions.lookup import count_below
from counterfoil.operators.timeline import ExpiryRun, admit_timeline

DAY = dt.date(2020, 1, 1)


def fold(requests, stock, runs, collected=(), pending=(), days=8):
    """Events one by one: (seq, kind, due, lines) and runs (after_seq, as_of)."""
    left, waiting, out, cancelled = dict(stock), [(due, lines, None) for due, lines in pending], {}, {}
    events = sorted([(s, 0, i) for i, (s, *_) in enumerate(requests)] + [(r.after_seq, 1, i) for i, r in enumerate(runs)])
    for _, is_run, i in events:
        if is_run:
            keep = []
            for due, lines, seq in waiting:
                if due is not None and due + dt.timedelta(days) <= runs[i].as_of:
                    for p, q in lines:
                        if left[p] is not None:
                            left[p] += q
                    cancelled[seq] = runs[i].as_of
                else:
                    keep.append((due, lines, seq))
            waiting = keep
            continue
        seq, kind, due, lines = requests[i]
        need = {}
        for p, q in lines:
            need[p] = need.get(p, 0) + q
        out[seq] = all(left[p] is None or left[p] >= q for p, q in need.items())
        if out[seq]:
            for p, q in need.items():
                if left[p] is not None:
                    left[p] -= q
            if kind == "Collection" and seq not in collected:
                waiting.append((due, lines, seq))
    return out, cancelled, left


def run_it(spark, requests, stock, runs, collected=(), pending=()):
    validated = spark.createDataFrame([(s, None, k, d) for s, k, d, _ in requests], "seq long, reason string, order_type string, due_day date")
    lines = spark.createDataFrame([(s, i, p, q) for s, _, _, ls in requests for i, (p, q) in enumerate(ls)],
                                  "seq long, pos int, product_id long, quantity int")
    inv = spark.createDataFrame([(p, f"p{p}", D("1.00"), s) for p, s in stock.items()],
                                "product_id long, product_desc string, price decimal(8,2), stock long")
    got = admit_timeline(validated, lines, inv, runs, spark.createDataFrame([(c,) for c in collected], "seq long"),
                         spark.createDataFrame([(d, p, q) for d, ls in pending for p, q in ls],
                                               "collection_date date, product_id long, quantity int"))
    rows = got.decisions.collect()
    assert all((r.reason is None) == r.accepted for r in rows) and len(rows) == len(requests)
    return ({r.seq: r.accepted for r in rows}, {r.seq: r.cancelled_on for r in rows if r.cancelled_on},
            {r.product_id: r.stock for r in got.inventory.collect()}, got)


@pytest.mark.parametrize("seed", range(2))
def test_timeline_equals_fold_of_events(spark, seed):
    rnd = random.Random(seed)
    products = range(1, 6)
    stock = {p: rnd.choice([None, 5, 20, 40, 80]) if p > 1 else 30 for p in products}
    requests = []
    for s in rnd.sample(range(1, 400), 160):
        kind = rnd.choice(["InStore", "Collection", "Collection", "Delivery"])
        due = None if rnd.random() < 0.05 else DAY + dt.timedelta(rnd.randrange(60))
        requests.append((s, kind, due, [(1 if rnd.random() < 0.4 else rnd.choice(products), rnd.randint(1, 7))
                                        for _ in range(rnd.randint(1, 3))]))
    places = sorted(rnd.choices(range(0, 420), k=7))
    dates = sorted(DAY + dt.timedelta(rnd.randrange(80)) for _ in places)
    runs = [ExpiryRun(a, d) for a, d in zip(places, dates)]
    collected = {s for s, *_ in requests if s % 5 == 0}
    pending = [(DAY + dt.timedelta(rnd.randrange(70)), [(rnd.choice(products), rnd.randint(1, 9))]) for _ in range(12)]
    accepted, cancelled, left, got = run_it(spark, requests, stock, runs, collected, pending)
    want, want_cancelled, want_left = fold(requests, stock, runs, collected, pending)
    want_cancelled.pop(None, None)
    assert (accepted, cancelled, left) == (want, want_cancelled, want_left)
    assert cancelled and not all(want.values()) and got.rounds > 1


def test_returned_stock_goes_to_a_later_request(spark):
    requests = [(1, "Collection", DAY, [(1, 8)]), (2, "InStore", None, [(1, 5)]), (5, "InStore", None, [(1, 5)])]
    for as_of, fits in ((DAY + dt.timedelta(7), False), (DAY + dt.timedelta(8), True)):
        accepted, cancelled, left, _ = run_it(spark, requests, {1: 10}, [ExpiryRun(3, as_of)])
        assert accepted == {1: True, 2: False, 5: fits}
        assert cancelled == ({1: as_of} if fits else {}) and left == {1: 5 if fits else 2}


def test_no_runs_and_no_requests(spark):
    assert run_it(spark, [], {1: 3}, [ExpiryRun(1, DAY)])[:3] == ({}, {}, {1: 3})
    accepted, cancelled, left, _ = run_it(spark, [(1, "Collection", DAY, [(1, 2)]), (2, "InStore", None, [(1, 2)])], {1: 3}, [])
    assert (accepted, cancelled, left) == ({1: True, 2: False}, {}, {1: 1})


def test_runs_must_be_in_time_order(spark):
    with pytest.raises(ValueError, match="time order"):
        run_it(spark, [], {1: 3}, [ExpiryRun(2, DAY), ExpiryRun(1, DAY)])


def test_count_below(spark):
    for items in ([], [3], [1, 1, 4, 9], list(range(0, 200, 3))):
        df = spark.createDataFrame([(v,) for v in [None, -1, 0, 1, 2, 3, 4, 9, 10, 198, 199, 500]], "v int")
        for r in df.select("v", count_below(F.col("v"), items).alias("n")).collect():
            assert r.n == (None if r.v is None else sum(x < r.v for x in items))


@pytest.mark.parametrize("limit", [4, 60])
def test_returns_within_and_between_blocks(spark, monkeypatch, limit):
    """Blocks of a few orders, many runs: stock returns in the block of its order and in later ones."""
    from counterfoil.operators import timeline
    monkeypatch.setattr(timeline, "FOLD_LINES", limit)
    widths, judge = [], timeline.judge_blocks
    monkeypatch.setattr(timeline, "judge_blocks", lambda state, width, older: widths.append(width) or judge(state, width, older))
    rnd = random.Random(limit)
    stock = {p: rnd.randint(8, 40) for p in range(1, 5)}
    requests = [(s, rnd.choice(["InStore", "Collection", "Collection"]), DAY + dt.timedelta(rnd.randrange(40)),
                 [(rnd.randint(1, 4), rnd.randint(1, 6)) for _ in range(rnd.randint(1, 3))]) for s in range(1, 121)]
    runs = [ExpiryRun(6 * i, DAY + dt.timedelta(3 * i)) for i in range(1, 20)]
    pending = [(DAY + dt.timedelta(rnd.randrange(40)), [(rnd.randint(1, 4), rnd.randint(1, 9))]) for _ in range(10)]
    accepted, cancelled, left, got = run_it(spark, requests, stock, runs, (), pending)
    want, want_cancelled, want_left = fold(requests, stock, runs, (), pending)
    want_cancelled.pop(None, None)
    assert (accepted, cancelled, left) == (want, want_cancelled, want_left)
    assert len(set(want.values())) == 2 and got.rounds == len(widths) > 1 and widths[-1] >= widths[0]
