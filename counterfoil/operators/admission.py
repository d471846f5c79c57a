"""All-or-nothing order admission against limited stock.

Sequential meaning (the reference's per-line trigger inside one
transaction per order): orders are taken in arrival order; an order is
accepted iff, for every product it names, its total quantity fits in what
the earlier *accepted* orders left (equality allowed); a rejected order
consumes nothing.  Untracked (NULL) stock always fits and stays NULL.

Parallel exact method (rounds of a two-bound fixpoint).  Each order is
accepted (A), rejected (R) or open (O).  In a round, every line of an
open order gets, over earlier orders on its product,

    lo = quantity of A orders,   hi = lo + quantity of O orders.

The real consumption before the line lies in [lo, hi], so an order whose
lines all have ``hi + q <= stock`` is accepted, one with any line
``lo + q > stock`` is rejected, and the rest stay open.  A task takes the orders
of a block of arrivals one by one, so what it decides counts at once for the
rest of its block (``operators.blocks``).  The first block with open orders is
always decided whole; as lines leave, blocks are merged.  The result equals the
sequential fold exactly -- no cap on rounds, no approximation.

Work is cut before the rounds: requests failing validation are out;
untracked products never constrain; a product whose total demand fits its
stock cannot reject anybody; an order that asks for more of a product than
the whole stock is rejected in the first round.  Only lines on *contested* products
iterate.  Blocks are ranges of a dense arrival index and hold at most
``FOLD_LINES`` lines or so; between them go sums of a row a block and product (a
hot product is in every block, never in one task).  Each round's state is written to the shared
checkpoint folder (Parquet files, whose size the planner knows), so lineage
stays one round deep and a lost executor recomputes at most one round; the
number of open lines comes with that write.

Chains of orders that wait for each other across many blocks would set the
number of rounds for all.  So from time to time (after 8, 16 ... rounds) the open
orders are split into components that share no contested product, found by
min-label propagation with pointer jumping over the lines that are left.  A
component of at most ``FOLD_LINES`` lines is folded in sequence, each by one
task, and leaves; larger ones go on in rounds.  When no more than ``FOLD_LINES``
lines are left in all, they are folded at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ids import dense_index
from ..session import discard, store, stored
from .blocks import ACCEPTED, OPEN, REJECTED, first_width, judge_blocks, wider

FOLD_ROUNDS = 16             # rejected orders of so many rounds become one table
FOLD_LINES = 200_000         # lines that one task folds in sequence at most
FIRST_SEARCH = 8             # rounds before components are looked for

@dataclass(frozen=True)
class Admission:
    decisions: DataFrame     # seq, accepted (bool), reason (NULL if accepted): a row for each request
    refused: DataFrame       # distinct seq of the valid requests that stock rejected
    rounds: int              # rounds run on contested products
    folded_lines: int        # lines of components that were folded in sequence


def contested_demand(lines: DataFrame, eligible: DataFrame, inventory: DataFrame) -> DataFrame:
    """(seq, product_id, qty, stock) with the other columns of ``eligible``
    for lines of eligible requests (``seq`` unique) on products whose total
    eligible demand exceeds their tracked stock.  A request that names a product
    twice has two rows."""
    demand = stored(lines.join(eligible.hint("shuffle_hash"), "seq")
                    .select(*eligible.columns, "product_id", F.col("quantity").cast("long").alias("qty")))
    tracked = inventory.filter(F.col("stock").isNotNull()).select("product_id", "stock")
    over = (demand.groupBy("product_id").agg(F.sum("qty").alias("_total"))
            .join(tracked, "product_id")
            .filter(F.col("_total") > F.col("stock"))
            .select("product_id", "stock"))
    return demand.join(over.hint("shuffle_hash"), "product_id")


def _round(state: DataFrame, width: int) -> DataFrame:
    """One round over (seq, at, product_id, qty, stock, st), st in {A, O}, in
    blocks of ``width`` places; see ``operators.blocks``."""
    return judge_blocks(state.withColumn("back_at", F.lit(None).cast("long")), width).drop("back_at")


def components(edges: DataFrame) -> DataFrame:
    """(product_id, label) of the products that orders connect; ``edges``:
    (seq, product_id), stored.  The label is the least product reached."""
    spark = edges.sparkSession
    labels, path = store(edges.select("product_id").distinct().withColumn("label", F.col("product_id")))
    while True:
        by_order = edges.join(labels, "product_id").groupBy("seq").agg(F.min("label").alias("_near"))
        near = edges.join(by_order, "seq").groupBy("product_id").agg(F.min("_near").alias("_near"))
        step = near.join(labels, "product_id")
        far = labels.select(F.col("product_id").alias("_near"), F.col("label").alias("_far"))
        moved = Observation()
        before = path
        labels, path = store(step.join(far, "_near").select("product_id", F.col("label").alias("_old"), F.least("_near", "_far").alias("label"))
                             .observe(moved, F.count_if(F.col("label") != F.col("_old")).alias("n"))
                             .drop("_old"))
        discard(spark, [before])
        if not moved.get["n"]:
            return labels


def _fold_component(table):
    """The orders of one component in arrival order: seq of those that do not fit."""
    used: dict[int, int] = {}
    refused = []
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "seq", "st", "product_id", "qty", "stock"))))
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        lines = rows[i:j]
        if lines[0][2] == ACCEPTED or all(used.get(p, 0) + q <= s for *_, p, q, s in lines):
            for *_, p, q, _ in lines:
                used[p] = used.get(p, 0) + q
        else:
            refused.append(lines[0][1])
        i = j
    return pa.table({"seq": pa.array(refused, pa.int64())})


def fold_small_components(state: DataFrame, limit: int = FOLD_LINES) -> tuple[DataFrame, DataFrame, int]:
    """(lines of larger components, seq that the fold of the others rejects,
    lines folded) of the rounds' ``state``."""
    lines = state.count()
    if lines <= limit:                       # one task's work at most, whatever its components
        some = state.withColumn("label", F.lit(0)).groupBy("label")
        return state.limit(0), stored(some.applyInArrow(_fold_component, "seq long")), lines
    edges = stored(state.filter(F.col("st") == OPEN).select("seq", "product_id"))
    labelled = stored(state.join(components(edges), "product_id"))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("_lines"))
    small = stored(sizes.filter(F.col("_lines") <= limit))
    some = labelled.join(small, "label")
    rejected = stored(some.groupBy("label").applyInArrow(_fold_component, "seq long"))
    rest = labelled.join(small.select("label"), "label", "left_anti").drop("label")
    return rest, rejected, small.agg(F.sum("_lines")).first()[0] or 0


def fold_rejected(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def admit_orders(validated: DataFrame, lines: DataFrame, inventory: DataFrame) -> Admission:
    """Decide every request.

    ``validated``: requests with ``reason`` (NULL = passed validation, with a
    ``seq`` of its own), stored ones with ``order_id`` if they are numbered in
    order of arrival already; ``lines``: (seq, pos, product_id, quantity);
    ``inventory``: current stock.

    Between rounds the state keeps open lines and the accepted lines that
    an open line after them on the same product depends on; rejected lines
    and accepted lines with nothing open after them can no longer change
    any decision and are dropped (the open set only shrinks).
    """
    numbered = "order_id" in validated.columns
    verdicts = validated if numbered else stored(validated.select("seq", "reason"))
    eligible = verdicts.filter(F.col("reason").isNull())
    order = (eligible.select("seq", F.col("order_id").alias("at")) if numbered
             else dense_index(eligible.select("seq"), "seq", "at"))
    state = stored(contested_demand(lines, order, inventory).withColumn("st", F.lit(OPEN)))
    open_lines, first, last = state.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    parallel = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = wider(state, first_width(open_lines, last - first + 1, parallel, FOLD_LINES),
                  FOLD_LINES, parallel) if open_lines else 1
    rejected = []
    rounds, folded, next_fold, kept = 0, 0, FIRST_SEARCH, 0
    files = []                   # of the rounds that ``rejected`` reads
    while open_lines:
        if rounds == next_fold or (rounds and kept <= FOLD_LINES):
            next_fold = max(next_fold, 2 * rounds)
            state, out, lines_out = fold_small_components(state)
            rejected.append(out)
            folded += lines_out
            open_lines = state.filter(F.col("st") == OPEN).count()
            if not open_lines:
                break
        if rounds:
            width = wider(state, width, FOLD_LINES)
        seen = Observation()
        needed = F.col("st") != REJECTED
        judged, path = store(_round(state, width).observe(
            seen, F.count_if(F.col("st") == OPEN).alias("open"), F.count_if(needed).alias("kept")))
        rounds += 1
        rejected.append(judged.filter(~needed).select("seq"))
        if len(rejected) > FOLD_ROUNDS:
            rejected = [stored(fold_rejected(rejected))]
            discard(judged.sparkSession, files)
            files = []
        files.append(path)
        state = judged.filter(needed)
        left, kept = seen.get["open"], seen.get["kept"]
        if left >= open_lines:
            raise RuntimeError("admission round made no progress")  # impossible by construction
        open_lines = left

    refused = fold_rejected(rejected) if rejected else verdicts.select("seq").limit(0)
    decisions = (verdicts.join(refused.withColumn("_stock", F.lit(True)), "seq", "left")
                 .withColumn("reason", F.when(F.col("reason").isNull() & F.col("_stock").isNotNull(),
                                              F.lit("stock")).otherwise(F.col("reason")))
                 .select("seq", F.col("reason").isNull().alias("accepted"), "reason"))
    return Admission(decisions, refused, rounds, folded)
