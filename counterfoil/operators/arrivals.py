"""Keys of an arriving batch against a large ledger (V1, V2, V9).

New rows are checked against the keys that the ledger holds, without reading
the ledger: the batch's keys are summed up as at most ``RANGES`` ranges (a
bounded list, whatever the batch's size), which are pushed to the parent's
scan, so a parent stored in key order skips the files and row groups without
such a key.  What is left meets the batch's distinct keys in a semi join; the
batch is the small side, broadcast once it is measured to be so, and the
parent's rows are neither shuffled nor sorted then.  The anti join that
finds the violations is between the batch and those few keys.

A key counts as known when the ledger or the batch itself holds it as parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables
from .quality import FOREIGN_KEYS, PRIMARY_KEYS, ROW_KEYS, _rows

RANGES = 64


def key_ranges(keys: DataFrame, key: str, ranges: int = RANGES) -> list[tuple[int, int]]:
    """At most ``ranges`` (least, greatest) that hold every key of ``keys``:
    the span is cut into equal parts, each shrunk to the keys in it."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    width = (high - low) // ranges + 1
    part = F.floor((F.col(key).cast("decimal(38,0)") - F.lit(low)) / F.lit(width))
    found = keys.filter(F.col(key).isNotNull()).groupBy(part.alias("_part")).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return sorted((r.a, r.b) for r in found.collect())


def known_keys(parent: DataFrame, pcol: str, keys: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """The distinct values of ``keys``.``key`` that ``parent`` holds in ``pcol``."""
    wanted = keys.select(F.col(key).alias(pcol)).filter(F.col(pcol).isNotNull()).distinct()
    spans = key_ranges(keys, key, ranges)
    if not spans:
        return wanted.filter(F.lit(False))
    inside = reduce(lambda a, b: a | b, [F.col(pcol).between(a, b) for a, b in spans])
    return parent.filter(inside).select(pcol).join(wanted, pcol, "left_semi").distinct()


def repeated_keys(batch: DataFrame, table: str, ledger: DataFrame) -> DataFrame:
    """V1 of a batch of a parent table: keys that are NULL, repeated in the
    batch, or in the ledger already (a row a key)."""
    (key,) = PRIMARY_KEYS[table]
    counted = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    there = known_keys(ledger, key, batch, key).withColumn("_there", F.lit(True))
    bad = counted.join(there, key, "left").filter(F.col(key).isNull() | (F.col("n") > 1) | F.col("_there").isNotNull())
    detail = (F.when(F.col(key).isNull(), "null key").when(F.col("_there").isNotNull(), "key in the ledger")
              .otherwise(F.concat(F.lit("duplicate key x"), F.col("n").cast("string"))))
    return _rows(bad, "V1", table, [key], detail)


def unknown_parents(batch: DataFrame, table: str, ledger: Tables, arriving: dict[str, DataFrame]) -> DataFrame:
    """V2 of a batch of a child table: rows whose parent is neither in the
    ledger nor among the ``arriving`` parents."""
    parts = []
    for child, col, parent, pcol in FOREIGN_KEYS:
        if child != table:
            continue
        known = known_keys(getattr(ledger, parent), pcol, batch, col)
        if parent in arriving:
            known = known.unionByName(arriving[parent].select(pcol)).distinct()
        missing = batch.join(known.select(F.col(pcol).alias("_known")), F.col(col) == F.col("_known"), "left_anti")
        parts.append(_rows(missing, "V2", table, [col], F.lit(f"{col} not in {parent}.{pcol}")))
    return reduce(DataFrame.unionByName, parts)


def check_arrivals(arriving: dict[str, DataFrame], ledger: Tables) -> DataFrame:
    """Every V1 and V2 violation of arriving rows (table name to rows):
    rule, table_name, row_key, detail, as ``quality.validate_tables`` finds
    them in the ledger with the batch added, for the batch's rows."""
    parts = [repeated_keys(df, name, getattr(ledger, name)) for name, df in arriving.items() if name in PRIMARY_KEYS]
    parts += [unknown_parents(df, name, ledger, arriving) for name, df in arriving.items()
              if any(child == name for child, *_ in FOREIGN_KEYS)]
    if not parts:
        raise ValueError(f"no table with keys to check among {sorted(arriving)} (known: {sorted(ROW_KEYS)})")
    return reduce(DataFrame.unionByName, parts)


def unknown_in_requests(lines: DataFrame, requests: DataFrame, ledger: Tables) -> DataFrame:
    """V9: (seq, reason) of requests that name a product or a staff member
    the ledger does not hold; ``product`` goes before ``staff``."""
    products = known_keys(ledger.inventory, "product_id", lines, "product_id")
    staff = known_keys(ledger.staff, "staff_id", requests, "staff_id")
    no_product = lines.join(products, "product_id", "left_anti").select("seq").distinct()
    no_staff = requests.join(staff, "staff_id", "left_anti").select("seq").distinct()
    both = no_product.withColumn("reason", F.lit("product")).unionByName(no_staff.withColumn("reason", F.lit("staff")))
    return both.groupBy("seq").agg(F.min("reason").alias("reason"))
