"""Integrity checks (V1-V8): the schema's constraints as bulk validation.

A database rejects a bad row when it is written; here a whole table is
checked at once and every violation becomes a row
``(rule, table_name, row_key, detail)``.  Checks are filters, anti joins
and one aggregate per key; they run as one union of independent scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import MAX_TEXT, ORDER_TYPES, TABLE_SCHEMAS
from ..tables import Tables

# Largest price NUMERIC(8,2) holds, allowed completion flags.
MAX_PRICE_EXCLUSIVE = 1_000_000
COMPLETED_VALUES = (0, 1)

PRIMARY_KEYS = {"inventory": ["product_id"], "orders": ["order_id"], "staff": ["staff_id"]}
# (child table, column, parent table, parent column)
FOREIGN_KEYS = [
    ("order_products", "order_id", "orders", "order_id"),
    ("order_products", "product_id", "inventory", "product_id"),
    ("deliveries", "order_id", "orders", "order_id"),
    ("collections", "order_id", "orders", "order_id"),
    ("staff_orders", "staff_id", "staff", "staff_id"),
    ("staff_orders", "order_id", "orders", "order_id"),
]
TEXT_COLUMNS = {
    "inventory": ["product_desc"],
    "orders": ["order_type"],
    "deliveries": ["fname", "lname", "house", "street", "city"],
    "collections": ["fname", "lname"],
    "staff": ["fname", "lname"],
}

VIOLATION_COLUMNS = ["rule", "table_name", "row_key", "detail"]


def _key(cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _rows(df: DataFrame, rule: str, table: str, key_cols, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     _key(key_cols).alias("row_key"), detail.alias("detail"))


def primary_key_violations(df: DataFrame, table: str, key) -> DataFrame:
    """V1: keys that are NULL or repeated (one row per offending key)."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    bad = counted.filter(null_key | (F.col("n") > 1))
    return _rows(bad, "V1", table, key,
                 F.when(null_key, F.lit("null key"))
                  .otherwise(F.concat(F.lit("duplicate key x"), F.col("n").cast("string"))))


ROW_KEYS = {"order_products": ["order_id", "product_id"], "deliveries": ["order_id"],
            "collections": ["order_id"], "staff_orders": ["staff_id", "order_id"], **PRIMARY_KEYS}


# V7: the due date of each child of orders that has one.
DUE_DATES = {"collections": "collection_date", "deliveries": "delivery_date"}


def _with_parents(tables: dict[str, DataFrame], table: str) -> tuple[DataFrame, list[tuple[str, Column, Column, list[str]]]]:
    """The table left-joined once to each parent it references, and the V2
    and V7 checks on the joined row."""
    df, checks = tables[table], []
    for child, col, parent, pcol in FOREIGN_KEYS:
        if child != table:
            continue
        # a parent key counts once, whatever V1 finds wrong with it
        keys = tables[parent].filter(F.col(pcol).isNotNull()).groupBy(F.col(pcol).alias(f"_{pcol}"))
        due = DUE_DATES.get(table) if parent == "orders" else None
        found = keys.agg(F.max("order_placed").alias("_placed")) if due else keys.agg(F.lit(True).alias(f"_has_{pcol}"))
        df = df.join(found, F.col(col) == F.col(f"_{pcol}"), "left")
        checks.append(("V2", F.col(f"_{pcol}").isNull(), F.lit(f"{col} not in {parent}.{pcol}"), [col]))
        if due:
            checks.append(("V7", F.col(due) < F.col("_placed"), F.lit(f"{due} before order_placed"), [col]))
    return df, checks


def _row_checks(table: str) -> list[tuple[str, Column, Column]]:
    """(rule, failing condition, detail) of every row-level rule of a table."""
    checks = [("V5", F.col(f.name).isNull(), F.lit(f"{f.name} is null"))
              for f in TABLE_SCHEMAS[table].fields if not f.nullable]
    if table == "orders":
        checks.append(("V3", ~F.coalesce(F.col("order_type").isin(*ORDER_TYPES), F.lit(False)),
                       F.concat(F.lit("order_type "), F.coalesce(F.col("order_type"), F.lit("NULL")))))
        checks.append(("V4", ~F.coalesce(F.col("completed").isin(*COMPLETED_VALUES), F.lit(False)),
                       F.concat(F.lit("completed "),
                                F.coalesce(F.col("completed").cast("string"), F.lit("NULL")))))
    if table == "order_products":
        checks.append(("V6", F.col("quantity") <= 0,
                       F.concat(F.lit("quantity "), F.col("quantity").cast("string"))))
    for c in TEXT_COLUMNS.get(table, []):
        checks.append(("V8", F.length(c) > MAX_TEXT,
                       F.concat(F.lit(f"{c} length "), F.length(c).cast("string"))))
    if table == "inventory":
        checks.append(("V8", F.abs("price") >= MAX_PRICE_EXCLUSIVE, F.lit("price out of range")))
    return checks


def row_violations(tables: dict[str, DataFrame], table: str) -> DataFrame:
    """V2-V8 of one table in a single pass: each row, joined to its parents,
    carries the array of its failing checks, which is exploded (a valid row
    emits nothing)."""
    df, checks = _with_parents(tables, table)
    checks = checks + [(rule, cond, detail, ROW_KEYS[table]) for rule, cond, detail in _row_checks(table)]
    failing = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), _key(key).alias("row_key"), detail.alias("detail")))
                  for rule, cond, detail, key in checks]),
        lambda v: v.isNotNull())
    return (df.select(F.explode(failing).alias("v"))
            .select(F.col("v.rule").alias("rule"), F.lit(table).alias("table_name"), "v.row_key", "v.detail"))


def validate_tables(t: Tables) -> DataFrame:
    """Every V1-V8 violation of the seven tables: one pass per table (with a
    join to each parent) and one aggregate per primary key."""
    tables = dict(t.items())
    parts = [primary_key_violations(tables[n], n, k) for n, k in PRIMARY_KEYS.items()]
    parts += [row_violations(tables, n) for n in TABLE_SCHEMAS]
    return reduce(DataFrame.unionByName, parts)


def split_valid(df: DataFrame, violations: DataFrame, table: str, key) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` (table ``table``) without / with a violation on ``key``.
    Both read ``violations``: pass a stored one (``checkpoint``)."""
    bad = violations.filter(F.col("table_name") == table).select(F.col("row_key").alias("_row_key")).distinct()
    keyed = df.withColumn("_row_key", _key(key))
    return (keyed.join(bad, "_row_key", "left_anti").drop("_row_key"),
            keyed.join(bad, "_row_key", "left_semi").drop("_row_key"))


# -- valid tables: rejects that cascade -------------------------------------------------------------
CASCADE = "cascade"          # reason of a row whose parent is there, but rejected


@dataclass(frozen=True)
class Cleaned:
    tables: Tables           # rows without any violation, all of whose parents are such rows
    rejects: DataFrame       # table_name, row_key, reasons (sorted, without repeats): a row for each rejected row


def parents_first() -> list[str]:
    """The tables in an order in which every parent comes before its children."""
    graph = TopologicalSorter({name: set() for name in TABLE_SCHEMAS})
    for child, _, parent, _ in FOREIGN_KEYS:
        graph.add(child, parent)
    return list(graph.static_order())


def _judged(df: DataFrame, table: str, judged: dict[str, DataFrame]) -> DataFrame:
    """``df`` with ``_reasons``: the rules that each row breaks by itself
    (V3-V8), by its key (V1) or by its parents (V2, V7, cascade)."""
    checks = [(rule, cond) for rule, cond, _ in _row_checks(table)]
    key = PRIMARY_KEYS.get(table)
    if key:
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        repeated = repeated.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.lit(True).alias("_repeated"))
        df = df.join(repeated, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in key]), "left")
        checks.append(("V1", F.col("_repeated").isNotNull() | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])))
    for i, (child, col, parent, pcol) in enumerate(FOREIGN_KEYS):
        if child != table:
            continue
        due = DUE_DATES.get(table) if parent == "orders" else None
        # the keys that the parent table has, and whether one is valid; all rows of a repeated key are rejected
        keys = (judged[parent].filter(F.col(pcol).isNotNull()).groupBy(F.col(pcol).alias(f"_p{i}"))
                .agg(F.max(F.size("_reasons") == 0).alias(f"_valid{i}"),
                     *([F.max("order_placed").alias("_placed")] if due else [])))
        df = df.join(keys, F.col(col) == F.col(f"_p{i}"), "left")
        checks += [("V2", F.col(f"_p{i}").isNull()), (CASCADE, ~F.col(f"_valid{i}"))]
        if due:
            checks.append(("V7", F.col(due) < F.col("_placed")))
    failing = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in checks]))
    return df.select(*TABLE_SCHEMAS[table].fieldNames(), F.sort_array(F.array_distinct(failing)).alias("_reasons"))


def clean_tables(t: Tables, materialize=None) -> Cleaned:
    """Valid tables and rejects, rejections running down the foreign keys.

    A row is rejected when it breaks a rule or when the row it references is
    rejected.  The keys form no cycle, so taking the tables parents first
    reaches the fixpoint in one pass a table: its rows meet, per parent, the
    keys with one flag (a map-side aggregate, so a hot parent is a row), and
    nothing is judged twice.  ``materialize`` (e.g. ``lambda df:
    df.checkpoint()``) is applied to each judged table, which feeds the valid
    rows, the rejects and the children.
    """
    keep = materialize or (lambda df: df)
    judged: dict[str, DataFrame] = {}
    for name in parents_first():
        judged[name] = keep(_judged(getattr(t, name), name, judged))
    valid = {name: df.filter(F.size("_reasons") == 0).drop("_reasons") for name, df in judged.items()}
    rejects = [df.filter(F.size("_reasons") > 0).select(
        F.lit(name).alias("table_name"), _key(ROW_KEYS[name]).alias("row_key"), F.col("_reasons").alias("reasons"))
        for name, df in judged.items()]
    return Cleaned(Tables(**valid), reduce(DataFrame.unionByName, rejects))
