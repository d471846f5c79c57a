"""Composed jobs: order placement (C9) and expiry runs (E6), each ending
in one all-or-nothing publish.

Interleaving rule: expiry returns stock that later orders may use, so
placement batches and expiry runs are applied in time order, each reading
the version the previous one published.  A job publishes the version after
the one its tables were read at; if another job has published meanwhile, it
fails with FileExistsError and nothing of it is seen, so stock is never sold
twice.  The caller reads the new version and runs it again.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_REFERENCE_DATE
from ..operators import expiry as E
from ..operators import intake as I
from ..operators.admission import admit_orders
from ..operators.stock import reduce_stock, stock_levels
from ..session import ensure_checkpoint_dir, stored
from ..sources.publish import CANCELLED, commit_note, latest_version, publish_changes
from ..tables import Tables

ORDER_KINDS = {1: "InStore", 2: "Collection", 3: "Delivery"}


@dataclass(frozen=True)
class Placement:
    tables: Tables          # tables with the accepted orders applied
    new_rows: dict[str, DataFrame]  # what the batch adds to the five order tables
    decisions: DataFrame    # seq, accepted, reason, order_id (NULL if no id used)
    rounds: int
    next_id: int            # next free order id (ids are not reused after a rejection)
    stock_after: DataFrame  # D3: stock of each accepted request's products after the batch


def materialize_requests(requests: DataFrame) -> DataFrame:
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(n, "seq").checkpoint(eager=True)


def next_order_id(t: Tables) -> int:
    top = t.orders.agg(F.max("order_id")).first()[0]
    return (top or 0) + 1


def place_orders(t: Tables, requests: DataFrame, kind: str | int | None = None,
                 id_start: int | None = None,
                 reference_date: _dt.date = DEFAULT_REFERENCE_DATE) -> Placement:
    """Validate, admit against stock, number and write a batch of
    requests (options 1-3; ``kind`` restricts to one order type)."""
    if isinstance(kind, int):
        kind = ORDER_KINDS[kind]
    if kind is not None:
        requests = requests.filter(F.col("order_type") == kind)
    # read by validation, line explosion and the builders: materialise once,
    # hash-partitioned by seq (parallel, and joins on seq can keep it)
    requests = materialize_requests(requests)
    # read by admission and by every builder, which take the lines apart from it
    validated = stored(I.validate_requests(requests, t.inventory, t.staff, reference_date).drop("products", "quantities"))
    lines = I.explode_order_lines(requests)
    # admission changes no id: a request that stock refuses uses one
    start = id_start if id_start is not None else next_order_id(t)
    ids = stored(I.assign_order_ids(validated.select("seq", "reason"), start))
    adm = admit_orders(ids, lines, t.inventory)
    # ``refused`` and the ids have a seq once and valid requests only, so each request stays one row
    reason = F.when(F.col("reason").isNull() & F.col("_stock").isNotNull(), "stock").otherwise(F.col("reason"))
    numbers = ids.filter(F.col("order_id").isNotNull()).select("seq", "order_id")
    numbered = stored(validated.join(adm.refused.withColumn("_stock", F.lit(True)).hint("shuffle_hash"), "seq", "left")
                      .join(numbers.hint("shuffle_hash"), "seq", "left")
                      .withColumn("reason", reason).drop("_stock")
                      .withColumn("accepted", F.col("reason").isNull()))
    top = numbered.agg(F.max("order_id")).first()[0]
    accepted = numbered.filter(F.col("accepted"))
    new_lines = I.build_order_products(accepted, lines)
    new_rows = {"orders": I.build_orders(accepted), "order_products": new_lines,
                "staff_orders": I.build_staff_orders(accepted),
                "collections": I.build_collections(accepted), "deliveries": I.build_deliveries(accepted)}
    tables = t.replace(inventory=reduce_stock(t.inventory, new_lines),
                       **{n: getattr(t, n).unionByName(df) for n, df in new_rows.items()})
    decisions = numbered.select("seq", "accepted", "reason", "order_id")
    stock_after = stock_levels(tables.inventory, lines.join(accepted.select("seq"), "seq", "left_semi"))
    return Placement(tables, new_rows, decisions, adm.rounds, start if top is None else top + 1, stock_after)


def _next_version(spark, root: str, t: Tables) -> int:
    """The version after the one ``t`` was read at (tables of another origin: after the newest)."""
    return (latest_version(spark, root) if t.version is None else t.version) + 1


def sequence_position(spark, root: str, t: Tables) -> int:
    """Next order id: the position recorded by the last published job.  Ids
    used by rejected or cancelled orders are not handed out again (the
    source's sequence is not rolled back).  Only a ledger whose last version
    has no position (its first snapshot) is scanned for it."""
    read = latest_version(spark, root) if t.version is None else t.version
    recorded = commit_note(spark, root, read).get("next_order_id") if read else None
    return recorded or next_order_id(t)


def run_placement(t: Tables, requests: DataFrame, root: str, job_id: str | None = None,
                  batch: tuple[str, int] | None = None, decisions_path: str | None = None,
                  **kwargs) -> tuple[int, Placement]:
    """C9 + S12-S14: place a batch and publish its new rows and the new stock.
    ``decisions_path``: folder for every request's decision, written before
    the version is committed (a job run again writes the same folder again)."""
    spark = t.orders.sparkSession
    version = _next_version(spark, root, t)
    if kwargs.get("id_start") is None:
        kwargs["id_start"] = sequence_position(spark, root, t)
    placed = place_orders(t, requests, **kwargs)
    note = {"job": "placement", "rounds": placed.rounds, "next_order_id": placed.next_id}
    if decisions_path:
        placed.decisions.write.mode("overwrite").parquet(decisions_path)
    done = publish_changes(spark, root, {**placed.new_rows, "inventory": placed.tables.inventory}, note, job_id,
                           version=version, batch=batch)
    return done, placed


def run_expiry(t: Tables, as_of, root: str, days: int = E.EXPIRY_DAYS,
               job_id: str | None = None) -> tuple[int, E.ExpiryResult]:
    """E6 + S14: one expiry run, published as the ids it cancelled and the
    new stock.  The removed set feeds both, so it is written to the
    checkpoint folder once."""
    spark = t.orders.sparkSession
    ensure_checkpoint_dir(spark)
    version = _next_version(spark, root, t)
    position = sequence_position(spark, root, t)        # carried forward
    result = E.expire_collections(t, as_of, days, materialize=lambda df: df.checkpoint(eager=True))
    note = {"job": "expiry", "as_of": str(as_of), "next_order_id": position}
    done = publish_changes(spark, root, {CANCELLED: result.cancelled, "inventory": result.tables.inventory}, note,
                           job_id, version=version)
    return done, result
