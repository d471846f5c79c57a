"""The tables and reports as temporary views for SQL users.

``register_views(t)`` names each DataFrame so that, e.g.,
``spark.sql("SELECT * FROM product_revenue")`` works like selecting from
the reference's views.  Views are lazy: nothing runs until queried, and a
query's filters and projections are optimised through the view.
"""

from __future__ import annotations

from ..operators import expiry as E
from ..operators import reports as R
from ..tables import Tables


def register_views(t: Tables, mode: str = "strict", prefix: str = "",
                   top_product_min=R.TOP_PRODUCT_MIN, lifetime_min=R.LIFETIME_SALES_MIN,
                   yearly_min=R.YEARLY_SALES_MIN) -> list[str]:
    t.register_views(prefix)
    views = {
        "sale_values": R.sale_values(t),
        "uncollected_collections": E.uncollected_collections(t),
        "product_revenue": R.product_revenue(t),
        "order_totals": R.order_totals(t, mode),
        "lifetime_sales": R.staff_lifetime_sales(t, lifetime_min, mode=mode),
        "top_product_sellers": R.top_product_sellers(t, top_product_min),
        "staff_by_top_value": R.staff_by_top_value(t, top_product_min),
        "staff_product_units": R.staff_product_units(t, top_product_min),
        "yearly_top_products": R.yearly_top_products(t, top_product_min, mode=mode),
        "staff_top_products": R.staff_top_products(t, top_product_min, mode=mode),
        "yearly_staff_sales": R.yearly_staff_sales(t, yearly_min, mode=mode),
        "staff_yearly_coverage": R.staff_yearly_coverage(
            t, top_product_min, staff_min=yearly_min, mode=mode),
        "employees_of_the_year": R.employees_of_the_year(
            t, None, top_product_min, staff_min=yearly_min, mode=mode),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in [*dict(t.items()), *views]]
