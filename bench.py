"""Benchmark the headline operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through a ``noop`` sink (every row produced,
nothing collected), once cold and once warm; the warm time is reported.  Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterfoil.operators import expiry as E            # noqa: E402
from counterfoil.operators import incremental as N       # noqa: E402
from counterfoil.operators import intake as I            # noqa: E402
from counterfoil.operators import reports as R           # noqa: E402
from counterfoil.operators.admission import admit_orders  # noqa: E402
from counterfoil.plans import catalog as C               # noqa: E402
from counterfoil.operators import quality as V           # noqa: E402
from counterfoil.plans.jobs import materialize_requests, run_placement  # noqa: E402
from counterfoil.session import ensure_checkpoint_dir, get_session  # noqa: E402
from counterfoil.sources.publish import publish, read_version  # noqa: E402
from counterfoil.sources.testdata import bind_requests, bind_tables  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app="counterfoil-bench",
                        shuffle_partitions=int(cpus) * 2,
                        conf={"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    ensure_checkpoint_dir(spark)

    def product_revenue():
        run(R.product_revenue(bind_tables(spark, sf_dir)))

    def staff_lifetime_sales():
        run(R.staff_lifetime_sales(bind_tables(spark, sf_dir, "customer"), C.LIFETIME_MIN))

    def staff_product_crosstab():
        run(R.staff_product_crosstab(bind_tables(spark, sf_dir), C.TOP_PRODUCT_MIN))

    def employees_of_the_year():
        run(R.employees_of_the_year(bind_tables(spark, sf_dir, "region"), None, C.YEAR_PRODUCT_MIN,
                                    staff_min=C.YEAR_STAFF_MIN))

    def expire_collections():
        res = E.expire_collections(bind_tables(spark, sf_dir), C.EXPIRY_AS_OF,
                                   materialize=lambda df: df.checkpoint(eager=True))
        for _, df in res.tables.items():
            run(df)

    def admit():
        t = bind_tables(spark, sf_dir)
        reqs = materialize_requests(bind_requests(spark, sf_dir))
        v = I.validate_requests(reqs, t.inventory, t.staff)
        adm = admit_orders(v, I.explode_order_lines(reqs), t.inventory)
        run(adm.decisions)
        return adm.rounds

    def staff_product_units():
        run(R.staff_product_units(bind_tables(spark, sf_dir), C.TOP_PRODUCT_MIN))

    def validate():
        run(V.validate_tables(bind_tables(spark, sf_dir)))

    # A first batch of half the requests onto an empty ledger, then the other
    # half onto the published one: the second must not pay for the first.
    ledger = {}

    def place(part):
        root = f"{ensure_checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}" if part == 0 else ledger["root"]
        if part == 0:
            ledger["root"] = root
            publish(C._no_orders(spark, bind_tables(spark, sf_dir)), root)
        run_placement(read_version(spark, root), bind_requests(spark, sf_dir).filter(f"seq % 2 = {part}"), root)

    def timeline():
        tl = C._timeline(spark, sf_dir)
        run(tl.decisions)
        return tl.rounds

    def clean():
        for _, df in V.clean_tables(bind_tables(spark, sf_dir), lambda df: df.checkpoint(eager=True)).tables.items():
            run(df)

    # the report aggregates after a batch of 1 % of the orders
    kept = {}

    def one_more_batch():
        t = bind_tables(spark, sf_dir, "region")
        keep = lambda df: df.checkpoint(eager=True)
        names = ("orders", "order_products", "staff_orders")
        if not kept:
            state = N.ledger_aggregates(t.replace(**{n: getattr(t, n).filter("order_id % 100 <> 0") for n in names}))
            kept["state"] = N.Aggregates(*[keep(df) for _, df in state.items()])
        change = N.delta({n: getattr(t, n).filter("order_id % 100 = 0") for n in names})
        run(N.winners(N.merged(kept["state"], change, keep), t.inventory, C.YEAR_PRODUCT_MIN, staff_min=C.YEAR_STAFF_MIN))

    queries = {
        "r2_product_revenue": product_revenue,
        "r4_staff_lifetime_sales": staff_lifetime_sales,
        "r8_staff_product_crosstab": staff_product_crosstab,
        "r8_staff_product_units": staff_product_units,
        "v_validate_tables": validate,
        "r13_employees_of_the_year": employees_of_the_year,
        "e6_expire_collections": expire_collections,
        "c3_admit_orders": admit,
        "c9_place_first_batch": lambda: place(0),
        "c9_place_second_batch": lambda: place(1),
        "c3_timeline_admission": timeline,
        "v_clean_tables": clean,
        "r13_after_a_batch": one_more_batch,
    }
    only = os.environ.get("BENCH_ONLY")
    if only:
        queries = {k: v for k, v in queries.items() if re.search(only, k)}

    # Each query runs twice in one session: the first (cold: class loading,
    # code generation, file listing) is reported separately; the second
    # (warm) is the measured time.
    times, cold, extra = {}, {}, {}
    for name, fn in queries.items():
        for attempt in ("cold", "warm"):
            t0 = time.perf_counter()
            out = fn()
            (cold if attempt == "cold" else times)[name] = round(time.perf_counter() - t0, 3)
        if out is not None:
            extra[f"{name}_rounds"] = out
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "cpus": int(cpus), "cold": cold, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
