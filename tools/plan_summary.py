"""Summarise the executed (final adaptive) plans of the headline queries.

    python tools/plan_summary.py [sf_dir]

For each query: shuffle exchanges, broadcast exchanges, join kinds, and
every file scan with its pushed filters and read schema.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from counterfoil.operators import expiry as E      # noqa: E402
from counterfoil.operators import reports as R     # noqa: E402
from counterfoil.plans import catalog as C         # noqa: E402
from counterfoil.session import ensure_checkpoint_dir, get_session  # noqa: E402
from counterfoil.sources.testdata import bind_tables  # noqa: E402


def summarise(name, df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = {k: plan.count(k) for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")}
    print(f"== {name}: shuffles={plan.count('Exchange hashpartitioning') + plan.count('Exchange rangepartitioning')}"
          f" broadcasts={plan.count('BroadcastExchange')} joins={joins}")
    for line in plan.splitlines():
        m = re.search(r"FileScan (\w+) \[[^\]]*\].*?Location: \w+\(\d+ paths\)\[([^\]]*)\].*?"
                      r"PushedFilters: (\[.*?\]), ReadSchema: (struct<.*?>)", line)
        if m:
            table = m.group(2).rstrip("/").split("/")[-1]
            print(f"   scan {table:22s} pushed={m.group(3)} read={m.group(4)}")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    ensure_checkpoint_dir(spark)
    summarise("R2 product_revenue", R.product_revenue(bind_tables(spark, sf)))
    summarise("R4 staff_lifetime_sales", R.staff_lifetime_sales(bind_tables(spark, sf, "customer"),
                                                               C.LIFETIME_MIN))
    summarise("R8 staff_product_crosstab (after cells are materialised)",
              R.staff_product_crosstab(bind_tables(spark, sf), C.TOP_PRODUCT_MIN))
    summarise("R13 employees_of_the_year (R9 materialised first)",
              R.employees_of_the_year(bind_tables(spark, sf, "region"), None, C.YEAR_PRODUCT_MIN))
    summarise("E6 expired order ids", E.expired_orders(bind_tables(spark, sf), C.EXPIRY_AS_OF))
    spark.stop()


if __name__ == "__main__":
    main()
