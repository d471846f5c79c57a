from decimal import Decimal as D

import pytest

from counterfoil.operators import reports as R
from counterfoil.operators.display import report_lines
from tests.fixtures import fanout, g1, g2


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_product_revenue_lists_unsold_and_sorts(spark):
    out = rows(R.product_revenue(g1(spark)), "product_id", "total_value")
    assert out == [(1, D("55000.00")), (2, D("47595.00")), (3, D("6.93")), (4, D("0.00"))]


def test_lifetime_sales_threshold_and_order(spark):
    out = rows(R.staff_lifetime_sales(g1(spark)), "full_name", "lifetime_sales")
    assert out == [("Bo Ray", D("52551.93")), ("Ada Li", D("50050.00"))]
    # inclusive boundary: exactly 50050.00 passes >=, fails >
    assert len(R.staff_lifetime_sales(g1(spark), 50050).collect()) == 2
    assert len(R.staff_lifetime_sales(g1(spark), 50050, inclusive=False).collect()) == 1


def test_fanout_default_and_compat(spark):
    t = fanout(spark)
    tot = dict(rows(R.order_totals(t), "order_id", "order_total"))
    assert tot[1] == D("25000.00")
    assert dict(rows(R.order_totals(t, "compat"), "order_id", "order_total"))[1] == D("50000.00")
    assert dict(rows(R.staff_lifetime_sales(t, 0), "staff_id", "lifetime_sales")) == {
        1: D("50050.00"), 2: D("77551.93")}
    assert dict(rows(R.staff_lifetime_sales(t, 0, mode="compat"), "staff_id", "lifetime_sales")) == {
        1: D("75050.00"), 2: D("102551.93")}


def test_top_products_strict_threshold(spark):
    t = g1(spark)
    assert sorted(rows(R.top_products(t), "product_id")) == [(1,), (2,)]
    assert sorted(rows(R.top_products(t, 47595), "product_id")) == [(1,)]
    assert sorted(rows(R.top_products(t, 47595, inclusive=True), "product_id")) == [(1,), (2,)]


def test_crosstab_and_ranking(spark):
    t = g1(spark)
    assert rows(R.staff_by_top_value(t), "staff_id", "total_value") == [
        (2, D("52545.00")), (1, D("50050.00"))]
    wide = R.staff_product_crosstab(t)
    assert wide.columns == ["full_name", "staff_id", "total_value", "cells"]
    assert [(r["full_name"], [tuple(c) for c in r["cells"]]) for r in wide.collect()] == [
        ("Bo Ray", [(1, 300), (2, 90)]), ("Ada Li", [(1, 250), (2, 100)])]
    long = rows(R.staff_product_units(t), "staff_id", "product_id", "units_sold")
    assert long == [(2, 1, 300), (2, 2, 90), (1, 1, 250), (1, 2, 100)]


def test_crosstab_leaves_out_unsold_products(spark):
    # staff 3 sells only product 2 in G2
    wide = R.staff_product_crosstab(g2(spark))
    got = {r["staff_id"]: [tuple(c) for c in r["cells"]] for r in wide.collect()}
    assert got[3] == [(2, 140)]


def test_crosstab_on_testdata(spark):
    """Non-empty at sf0.001 with a lower threshold, and equal to the long form."""
    from counterfoil.sources.testdata import bind_tables
    t = bind_tables(spark, "/root/testdata/sf0.001")
    wide = R.staff_product_crosstab(t, 900_000).collect()
    long = R.staff_product_units(t, 900_000).collect()
    assert wide and len(long) > 100
    assert [(r["staff_id"], r["total_value"], c["product_id"], c["units_sold"]) for r in wide for c in r["cells"]] == [
        (r["staff_id"], r["total_value"], r["product_id"], r["units_sold"]) for r in long]


def test_builders_and_views_start_no_job(spark):
    from counterfoil.plans.views import register_views
    t = g1(spark)
    spark.sparkContext.setJobGroup("lazy", "builders")
    register_views(t, prefix="lazy_")
    register_views(t, mode="compat", prefix="lazy_c_")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)


def test_yearly_top_products(spark):
    out = sorted(rows(R.yearly_top_products(g1(spark)), "yr", "product_id", "total_value"))
    assert out == [(2019, 2, D("22545.00")), (2020, 1, D("55000.00")), (2020, 2, D("25050.00"))]
    g2_2019 = [r for r in rows(R.yearly_top_products(g2(spark)), "yr", "product_id", "total_value")
               if r[0] == 2019]
    assert g2_2019 == [(2019, 2, D("57615.00"))]


def test_yearly_staff_sales(spark):
    out = rows(R.yearly_staff_sales(g1(spark)), "staff_id", "yr", "total_sales")
    assert out == [(1, 2020, D("50050.00")), (2, 2020, D("30006.93"))]


@pytest.mark.parametrize("fixture,year,mode,expected", [
    (g1, 2020, "strict", ["Ada Li"]),
    (g1, 2020, "compat", ["Ada Li", "Bo Ray"]),
    (g1, 2019, "strict", []),
    (g1, 2019, "compat", []),
    (g2, 2019, "strict", ["Cy Dee"]),
    (g2, 2019, "compat", ["Ada Li", "Bo Ray", "Cy Dee"]),
    (g2, 2020, "strict", ["Ada Li"]),
])
def test_employees_of_the_year(spark, fixture, year, mode, expected):
    out = R.employees_of_the_year(fixture(spark), year, mode=mode)
    assert [r["full_name"] for r in out.collect()] == expected


def test_employees_all_years_matches_single_years(spark):
    t = g2(spark)
    every = {(r["yr"], r["staff_id"]) for r in R.employees_of_the_year(t).collect()}
    single = {(y, r["staff_id"]) for y in (2019, 2020)
              for r in R.employees_of_the_year(t, y).collect()}
    assert every == single


def test_year_without_top_products_has_no_winner(spark):
    # threshold above every yearly value: no top product, nobody wins (Q21)
    assert R.employees_of_the_year(g1(spark), 2020, product_min=10**9).count() == 0


def test_strict_subset_of_compat_with_one_staff_per_order(spark):
    t = g2(spark)
    strict = {tuple(r) for r in R.employees_of_the_year(t).collect()}
    compat = {tuple(r) for r in R.employees_of_the_year(t, mode="compat").collect()}
    assert strict <= compat


def test_sale_values_fan_out(spark):
    assert R.sale_values(fanout(spark)).count() == 7   # 6 lines + order 1 twice


def test_report_lines_truncate_pence(spark):
    lines = [r[0] for r in report_lines(R.staff_lifetime_sales(g1(spark))).collect()]
    assert lines[0] == "Bo Ray," + " " * 23 + " " + "£52551" + " " * 24
    prod = [r[0] for r in report_lines(R.product_revenue(g1(spark))).collect()]
    assert prod[2].startswith("3," + " " * 28 + " " + "Bolt," + " " * 25 + " £6")


def test_sql_views(spark):
    from counterfoil.plans.views import register_views
    names = register_views(g1(spark), prefix="g1_")
    assert "g1_product_revenue" in names and "g1_orders" in names
    got = spark.sql("SELECT product_id FROM g1_product_revenue WHERE total_value > 20000 "
                    "ORDER BY product_id").collect()
    assert [r[0] for r in got] == [1, 2]
    eoy = spark.sql("SELECT full_name FROM g1_employees_of_the_year WHERE yr = 2020").collect()
    assert [r[0] for r in eoy] == ["Ada Li"]


def _one_sale(spark, value_pennies, year=2020, staff=1):
    """One in-store order of product 9 priced value/100 x 1 unit."""
    from datetime import date
    from counterfoil.tables import Tables
    price = D(value_pennies) / 100
    return Tables.from_rows(
        spark, inventory=[(9, "P", price, None)], staff=[(1, "Ada", "Li"), (2, "Bo", "Ray")],
        orders=[(1, "InStore", 1, date(year, 6, 1))], order_products=[(1, 9, 1)],
        staff_orders=[(staff, 1)])


@pytest.mark.parametrize("pennies,shown", [(4999999, False), (5000000, True)])
def test_lifetime_boundary(spark, pennies, shown):
    assert (R.staff_lifetime_sales(_one_sale(spark, pennies)).count() == 1) == shown


@pytest.mark.parametrize("pennies,top", [(2000000, False), (2000001, True)])
def test_yearly_top_product_boundary_is_strict(spark, pennies, top):
    assert (R.yearly_top_products(_one_sale(spark, pennies)).count() == 1) == top


@pytest.mark.parametrize("pennies,passed", [(2999999, False), (3000000, True)])
def test_yearly_staff_sales_boundary_is_inclusive(spark, pennies, passed):
    assert (R.yearly_staff_sales(_one_sale(spark, pennies)).count() == 1) == passed


def test_single_order_worth_30k_is_employee_of_the_year(spark):
    # one order, one product worth 30,000: top product (> 20,000) and 30k seller
    out = R.employees_of_the_year(_one_sale(spark, 3000000), 2020)
    assert [r["full_name"] for r in out.collect()] == ["Ada Li"]
    assert R.employees_of_the_year(_one_sale(spark, 3000000), 2019).count() == 0
