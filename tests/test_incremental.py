import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from counterfoil.operators import incremental as N
from counterfoil.operators import reports as R
from tests.fixtures import STAFF
from counterfoil.tables import Tables

LIMITS = dict(product_min=300, staff_min=500)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _batch(rnd, first, count):
    orders, lines, links = [], [], []
    for oid in range(first, first + count):
        orders.append((oid, "InStore", 1, None if rnd.random() < 0.05 else date(rnd.choice([2018, 2019, 2020]), 3, 1)))
        lines += [(oid, 1 if rnd.random() < 0.5 else rnd.randint(2, 5), rnd.randint(1, 9)) for _ in range(rnd.randint(0, 3))]
        links += [(s, oid) for s in rnd.choices([1, 2, 3], k=rnd.choice([0, 1, 1, 1, 2]))]
    return orders, lines, links


def test_three_batches_equal_the_full_reports(spark):
    rnd = random.Random(21)
    inventory = [(p, f"p{p}", D(rnd.randint(100, 900)) / 100, 10) for p in range(1, 7)]
    all_rows = ([], [], [])
    t = Tables.from_rows(spark, inventory=inventory, staff=STAFF)
    state = N.ledger_aggregates(t)
    won = N.winners(state, t.inventory, **LIMITS)
    keep = lambda df: df.checkpoint(eager=True)
    entered_and_left = set()
    for i, (count, repriced) in enumerate(((60, ()), (25, (1, 4)), (0, ()))):
        orders, lines, links = _batch(rnd, 1000 * i, count)
        added = Tables.from_rows(spark, orders=orders, order_products=lines, staff_orders=links)
        gone = rnd.sample([o[0] for o in all_rows[0]], len(all_rows[0]) * i // 3)
        change = N.delta({n: getattr(added, n) for n in ("orders", "order_products", "staff_orders")}, t,
                         spark.createDataFrame([(o,) for o in gone], "order_id long"))
        inventory = [(p, d, price * 2 if p in repriced else price, s) for p, d, price, s in inventory]
        for k, new in enumerate((orders, lines, links)):
            column = 1 if k == 2 else 0
            all_rows[k][:] = [r for r in all_rows[k] if r[column] not in gone] + new
        before, old_prices = state, t.inventory
        t = Tables.from_rows(spark, inventory=inventory, staff=STAFF, orders=all_rows[0], order_products=all_rows[1], staff_orders=all_rows[2])
        over = lambda a: {r.product_id for r in N.top_products(a, t.inventory, 300).collect()}
        state = N.merged(before, change, keep)
        crossed = {r.product_id: r.entered for r in N.crossed(before, change, t.inventory, 300).collect()}
        assert {p for p, e in crossed.items() if e} == over(state) - over(before)
        assert {p for p, e in crossed.items() if not e} == over(before) - over(state)
        entered_and_left |= set(crossed.values())
        years = keep(N.changed_years(change, state, spark.createDataFrame([(p,) for p in repriced], "product_id long")))
        won = keep(N.updated_winners(won, state, years, t.inventory, **LIMITS))

        full = N.ledger_aggregates(t)
        for name, df in state.items():
            assert _rows(df.select(*sorted(df.columns))) == _rows(getattr(full, name).select(*sorted(df.columns)))
        assert _rows(N.product_revenue(state, t.inventory)) == _rows(R.product_revenue(t))
        assert _rows(N.yearly_top_products(state, t.inventory, 300)) == _rows(R.yearly_top_products(t, 300))
        assert _rows(N.yearly_staff_sales(state, t.inventory, 500)) == _rows(R.yearly_staff_sales(t, 500))
        assert _rows(N.employees_of_the_year(won, t.staff)) == _rows(R.employees_of_the_year(t, None, 300, staff_min=500))
        assert _rows(N.yearly_top_products(state, t.inventory, 300))
    assert entered_and_left == {True, False}


def test_only_changed_years_are_divided_again(spark):
    t = Tables.from_rows(spark, inventory=[(1, "a", D("1.00"), 1)], staff=STAFF, orders=[(1, "InStore", 1, date(2019, 1, 1))],
                         order_products=[(1, 1, 9)], staff_orders=[(1, 1)])
    kept = spark.createDataFrame([(2018, 3), (2019, 2)], "yr int, staff_id long")   # what was answered before
    state = N.ledger_aggregates(t)
    years = spark.createDataFrame([(2019,)], "yr int")
    got = N.updated_winners(kept, state, years, t.inventory, product_min=1, staff_min=1)
    assert _rows(got) == [(2018, 3), (2019, 1)]
