"""Admission and expiry in one timeline (C3 with E6).

Requests arrive in ``seq`` order; between them expiry runs take place.  A run
with cut-off date ``as_of`` cancels every accepted collection order placed
before it that nobody collected and whose collection date lies ``days`` or
more before ``as_of``; its quantities return to stock, so a later request may
be accepted that would have been refused.

When an accepted order returns its stock does not depend on any verdict: at
the first run after it whose cut-off covers its date.  Whether it returns
anything does.  So an order j uses, at a later place p, either its quantity (if
accepted, and p lies before its return) or nothing, and

    lo = quantity of accepted orders before p that have not returned by p,
    hi = lo + quantity of open orders before p that have not returned by p

enclose the real use at p, less what older orders of the ledger return by
then.  The rounds are those of ``operators.blocks`` with these two bounds:
accept when every line fits under hi, reject when one fails under lo.  The
first block with open orders is decided whole, so every round decides one at
least.

A line counts as two events on its product, its quantity at the order's place
and minus that at the return; returns of one product and run to a block are
summed first, so a run that returns a third of all lines is a row a product and
block.  The runs are parameters of
the job (a list); nothing else reaches the driver but counts.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ids import dense_index
from ..functions.lookup import count_below
from ..session import discard, ensure_checkpoint_dir, store, stored
from .admission import FOLD_LINES, FOLD_ROUNDS, contested_demand, fold_rejected
from .blocks import OPEN, REJECTED, first_width, judge_blocks, wider
from .expiry import EXPIRY_DAYS
from .stock import reduce_stock, restock


@dataclass(frozen=True)
class ExpiryRun:
    after_seq: int           # takes place after the requests up to this one
    as_of: _dt.date


@dataclass(frozen=True)
class Timeline:
    decisions: DataFrame     # seq, accepted, reason, cancelled_on (as_of of the run that cancels it, or NULL)
    inventory: DataFrame     # stock after the last event
    cancelled_lines: DataFrame   # seq, product_id, quantity that the runs returned
    rounds: int


def _in_order(runs: list[ExpiryRun]) -> list[ExpiryRun]:
    for a, b in zip(runs, runs[1:]):
        if a.after_seq > b.after_seq or a.as_of > b.as_of:
            raise ValueError("expiry runs must be in time order, by place and by cut-off date")
    return list(runs)


def return_run(runs: list[ExpiryRun], seq, due, days: int):
    """Index of the run that cancels an order placed at ``seq`` (NULL: before
    all requests) and due on ``due``; NULL if none does."""
    by_place = F.coalesce(count_below(seq, [r.after_seq for r in runs]), F.lit(0))
    by_date = count_below(F.date_add(due, days), [r.as_of for r in runs])
    first = F.greatest(by_place, by_date)      # NULL only for a NULL date ...
    return F.when(by_date.isNotNull() & (first < len(runs)), first)   # ... which never expires


def _at(positions: list[int], run):
    return F.element_at(F.array(*[F.lit(p) for p in positions]).cast("array<bigint>"), (run + 1).cast("int")) \
        if positions else F.lit(None).cast("bigint")


def admit_timeline(validated: DataFrame, lines: DataFrame, inventory: DataFrame, runs: list[ExpiryRun],
                   collected: DataFrame | None = None, pending: DataFrame | None = None,
                   days: int = EXPIRY_DAYS) -> Timeline:
    """Decide every request, with the expiry runs between them.

    ``validated``, ``lines``, ``inventory`` as in ``admit_orders``, with
    ``order_type`` and ``due_day`` in ``validated``; ``collected``: seq of
    requests that were picked up, which no run cancels; ``pending``:
    (collection_date, product_id, quantity) of older orders that wait in the
    ledger and may be cancelled.
    """
    ensure_checkpoint_dir(validated.sparkSession)
    runs = _in_order(runs)
    back = F.when(F.col("reason").isNull() & (F.col("order_type") == "Collection"),
                  return_run(runs, F.col("seq"), F.col("due_day"), days))
    verdicts = validated.select("seq", "reason", back.alias("back"))
    if collected is not None:
        gone = collected.select("seq").distinct().withColumn("_gone", F.lit(True))
        verdicts = verdicts.join(gone, "seq", "left").select(
            "seq", "reason", F.when(F.col("_gone").isNull(), F.col("back")).alias("back"))
    verdicts = stored(verdicts)

    older = None
    if pending is not None:
        older = stored(pending.select("product_id", "quantity", return_run(runs, F.lit(None).cast("bigint"), F.col("collection_date"), days)
                                      .alias("back")).filter(F.col("back").isNotNull())
                       .groupBy("product_id", "back").agg(F.sum("quantity").cast("bigint").alias("qty")))

    # places: even for requests, odd for the runs between them
    eligible = verdicts.filter(F.col("reason").isNull()).select("seq", "back")
    order = dense_index(eligible, "seq", "_at").withColumn("at", F.col("_at") * 2)
    earlier = {r["runs"]: r["n"] for r in order.groupBy(count_below(F.col("seq"), [r.after_seq for r in runs]).alias("runs"))
               .agg(F.count(F.lit(1)).alias("n")).collect()}           # a row a run
    place = [2 * n + 1 for n in accumulate(earlier.get(i, 0) for i in range(len(runs)))]
    order = order.select("seq", "at", _at(place, F.col("back")).alias("back_at"))
    state = stored(contested_demand(lines, order, inventory).withColumn("st", F.lit(OPEN)))
    if older is not None:
        older_back = stored(older.join(state.select("product_id").distinct(), "product_id", "left_semi").select(
            "product_id", _at(place, F.col("back")).alias("at"), "qty"))
    else:
        older_back = None

    open_lines, first, last = state.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    parallel = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = wider(state, first_width(open_lines, last - first + 1, parallel, FOLD_LINES),
                  FOLD_LINES, parallel) if open_lines else 1
    rejected, rounds, files = [], 0, []
    while open_lines:
        if rounds:
            width = wider(state, width, FOLD_LINES)
        seen = Observation()
        judged, path = store(judge_blocks(state, width, older_back).observe(
            seen, F.count_if(F.col("st") == OPEN).alias("open")))
        rounds += 1
        rejected.append(judged.filter(F.col("st") == REJECTED).select("seq"))
        if len(rejected) > FOLD_ROUNDS:
            rejected = [stored(fold_rejected(rejected))]
            discard(judged.sparkSession, files)
            files = []
        files.append(path)
        state = judged.filter(F.col("st") != REJECTED)
        if seen.get["open"] >= open_lines:
            raise RuntimeError("timeline round made no progress")  # impossible by construction
        open_lines = seen.get["open"]

    refused = (fold_rejected(rejected) if rejected else verdicts.select("seq").limit(0)).withColumn("_stock", F.lit(True))
    days_of = F.array(*[F.lit(r.as_of) for r in runs]) if runs else F.array().cast("array<date>")
    reason = F.when(F.col("reason").isNull() & F.col("_stock").isNotNull(), "stock").otherwise(F.col("reason"))
    decided = stored(verdicts.join(refused, "seq", "left").withColumn("reason", reason))
    accepted = F.col("reason").isNull()
    decisions = decided.select("seq", accepted.alias("accepted"), "reason",
                               F.when(accepted, F.get(days_of, F.col("back").cast("int"))).alias("cancelled_on"))
    sold = lines.join(decided.filter(accepted).select("seq", "back"), "seq")
    gone = sold.filter(F.col("back").isNotNull()).select("seq", "product_id", "quantity")
    returned = gone.select("product_id", "quantity")
    if older is not None:
        returned = returned.unionByName(older.select("product_id", F.col("qty").alias("quantity")))
    return Timeline(decisions, restock(reduce_stock(inventory, sold), returned), gone, rounds)
