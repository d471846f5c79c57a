"""Order intake (C1, C2, C4-C8, C10 and request validation V6, V7, V9).

A request is one till order: parallel product / quantity arrays, dates as
``dd-MMM-yy`` text, customer name and address for collection and
delivery, and the selling staff member.  Requests are checked in bulk and
get the first failing reason, in this order:

    seq, type, date, lines, quantity, text, product, staff   (then stock, in admission)

``seq`` is a request's identity and arrival order: a missing one, and every
copy of a repeated one, is rejected, so each request gets exactly one
decision.  A request flagged ``again`` (a column that the order stream adds)
repeats a ``seq`` that was decided earlier, and is rejected alike.  ``text`` is the schema's rule for names and addresses (present
where the order type needs them, at most 30 characters).  Requests passing
seq, type, date, lines and quantity reach the insert step and consume an
order id even if later rejected (the id sequence is not rolled back), so
accepted orders may have gaps between their ids.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_REFERENCE_DATE, parse_request_date
from ..functions.ids import dense_index
from ..session import stored
from ..sources.schemas import MAX_TEXT, ORDER_TYPES

REASONS = ("seq", "type", "date", "lines", "quantity", "text", "product", "staff", "stock")
# Reasons that stop a request before it reaches the insert (no id used).
PRE_INSERT_REASONS = ("seq", "type", "date", "lines", "quantity")
# Text columns that each order type writes, none of them NULL.
TYPE_TEXT = {"Collection": ("fname", "lname"),
             "Delivery": ("fname", "lname", "house", "street", "city")}


def coerce_requests(raw: DataFrame) -> DataFrame:
    """Requests typed as text (as read from a form, csv or untyped json) to
    the request schema: text is trimmed, ids and quantities go through
    ``try_cast`` so a malformed number becomes NULL and the request is
    rejected by validation ('seq', 'lines', 'quantity' or 'staff') instead of
    failing the job.  ``products`` / ``quantities`` may be arrays of text,
    ``;``-separated text or the text of a JSON array (as an untyped json
    reader gives it)."""
    def as_array(name, to):
        c = F.col(name)
        if not dict(raw.dtypes)[name].startswith("array"):
            c = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ";"))
        return F.transform(c, lambda x: F.trim(x.cast("string")).try_cast(to))

    text = ["order_type", "sale_date", "due_date", "fname", "lname", "house", "street", "city"]
    return raw.select(
        F.trim(F.col("seq").cast("string")).try_cast("long").alias("seq"),
        F.trim("order_type").alias("order_type"),
        as_array("products", "long").alias("products"),
        as_array("quantities", "int").alias("quantities"),
        *[F.trim(F.col(c).cast("string")).alias(c) for c in text[1:]],
        F.trim(F.col("staff_id").cast("string")).try_cast("long").alias("staff_id"))


def explode_order_lines(requests: DataFrame) -> DataFrame:
    """(seq, pos, product_id, quantity), one row per array position of
    requests whose arrays have equal, non-zero length."""
    ok = (F.col("products").isNotNull() & F.col("quantities").isNotNull()
          & (F.size("products") == F.size("quantities")) & (F.size("products") > 0))
    return (requests.filter(ok)
            .select("seq", F.posexplode(F.arrays_zip(F.col("products").alias("product_id"),
                                                     F.col("quantities").alias("quantity")))
                    .alias("pos", "line"))
            .select("seq", "pos", F.col("line.product_id").alias("product_id"),
                    F.col("line.quantity").alias("quantity")))


def validate_requests(requests: DataFrame, inventory: DataFrame, staff: DataFrame,
                      reference_date: _dt.date = DEFAULT_REFERENCE_DATE) -> DataFrame:
    """Requests with parsed dates (``sale_day``, ``due_day``) and ``reason``
    (NULL when no rule short of stock fails)."""
    sale = parse_request_date("sale_date", reference_date)
    due = parse_request_date("due_date", reference_date)
    needs_due = F.col("order_type").isin("Collection", "Delivery")
    r = requests.withColumn("sale_day", sale).withColumn(
        "due_day", F.when(needs_due, due))
    lines_ok = (F.col("products").isNotNull() & F.col("quantities").isNotNull()
                & (F.size("products") == F.size("quantities")) & (F.size("products") > 0))
    qty_ok = F.forall("quantities", lambda q: q.isNotNull() & (q > 0))
    ids_ok = F.forall("products", lambda p: p.isNotNull())
    date_ok = F.col("sale_day").isNotNull() & (
        ~needs_due | (F.col("due_day").isNotNull() & (F.col("due_day") >= F.col("sale_day"))))

    # V9: products and staff must exist.  The seq that fail a check are stored:
    # mostly few, so the planner knows that whole requests need not be dealt out
    # to meet them.
    lines = explode_order_lines(requests)
    unknown_product = (lines.join(inventory.select("product_id").hint("shuffle_hash"), "product_id", "left_anti")
                       .select("seq", F.lit(0).alias("_n"), F.lit(True).alias("_no_product")))
    known_staff = staff.select("staff_id", F.lit(True).alias("_staff_ok"))
    flagged = stored(requests.select("seq", F.lit(1).alias("_n"), F.lit(False).alias("_no_product"))
                     .unionByName(unknown_product).groupBy("seq")
                     .agg((F.sum("_n") > 1).alias("_repeated"), F.max("_no_product").alias("_no_product"))
                     .filter(F.col("seq").isNotNull() & (F.col("_repeated") | F.col("_no_product"))))
    r = (r.join(known_staff, "staff_id", "left").join(flagged, "seq", "left")
         .withColumn("_no_staff", F.col("_staff_ok").isNull()))
    text_ok = F.lit(True)
    for kind, columns in TYPE_TEXT.items():
        fits = F.lit(True)
        for c in columns:
            fits = fits & F.col(c).isNotNull() & (F.length(c) <= MAX_TEXT)
        text_ok = text_ok & ((F.col("order_type") != kind) | fits)
    again = F.coalesce(F.col("again"), F.lit(False)) if "again" in requests.columns else F.lit(False)
    reason = (F.when(F.col("seq").isNull() | F.coalesce(F.col("_repeated"), F.lit(False)) | again, "seq")
              .when(~F.coalesce(F.col("order_type").isin(*ORDER_TYPES), F.lit(False)), "type")
              .when(~date_ok, "date")
              .when(~lines_ok | ~F.coalesce(ids_ok, F.lit(False)), "lines")
              .when(~F.coalesce(qty_ok, F.lit(False)), "quantity")
              .when(~F.coalesce(text_ok, F.lit(False)), "text")
              .when(F.coalesce(F.col("_no_product"), F.lit(False)), "product")
              .when(F.coalesce(F.col("_no_staff"), F.lit(False)), "staff"))
    return r.withColumn("reason", reason).drop("_no_product", "_no_staff", "_staff_ok", "_repeated")


def assign_order_ids(decided: DataFrame, start: int) -> DataFrame:
    """``order_id`` for every request that reached the insert step,
    increasing in arrival (``seq``) order from ``start``; NULL for the rest."""
    reached = decided.filter(F.col("reason").isNull() | ~F.col("reason").isin(*PRE_INSERT_REASONS))
    ids = dense_index(reached.select("seq"), "seq", "order_id", start)
    return decided.join(ids, "seq", "left")


def build_orders(accepted: DataFrame) -> DataFrame:
    """C4: order rows; in-store orders are complete at once."""
    return accepted.select(
        "order_id", "order_type",
        F.when(F.col("order_type") == "InStore", 1).otherwise(0).alias("completed"),
        F.col("sale_day").alias("order_placed"))


def build_order_products(accepted: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per request line (repeats kept), under the new id."""
    return (lines.join(accepted.select("seq", "order_id"), "seq")
            .select("order_id", "product_id", "quantity"))


def build_staff_orders(accepted: DataFrame) -> DataFrame:
    """The selling staff member's link to the order."""
    return accepted.select("staff_id", "order_id")


def build_collections(accepted: DataFrame) -> DataFrame:
    """Pickup rows of collection orders."""
    return (accepted.filter(F.col("order_type") == "Collection")
            .select("order_id", "fname", "lname", F.col("due_day").alias("collection_date")))


def build_deliveries(accepted: DataFrame) -> DataFrame:
    """Address rows of delivery orders."""
    return (accepted.filter(F.col("order_type") == "Delivery")
            .select("order_id", "fname", "lname", "house", "street", "city",
                    F.col("due_day").alias("delivery_date")))
