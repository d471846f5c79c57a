"""One round of the two-bound fixpoint of admission, a block of arrivals a task.

The lines of the open orders are cut into blocks of consecutive places; those
of one order on one product are summed by the task that takes the block.  For
each product that a block's lines name, the blocks before it give

    lo     = quantity that accepted orders use when the block begins,
    unsure = quantity that open orders may use besides;

sums of one row a block and product, so a hot product is a row a block.  A task
then takes the orders of its block one by one with these bounds: accepted when
every line fits under lo + unsure, rejected when one does not fit under lo,
else open and unsure for those after it.  What it decides counts at once for
the rest of the block, so a chain of orders that wait for each other costs a
round a block, not a round an order; the first block with open orders is always
decided whole.  A block holds a bounded number of lines, whatever the input.

Stock may return: an order with ``back_at`` uses its quantity up to that place
only.  Orders of earlier blocks return as they stood before the round, those of
the block as they were just decided.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED, REJECTED, OPEN = "A", "R", "O"
STATE = "at long, seq long, product_id long, qty long, stock long, back_at long, st string"
_COLUMNS = [c.split()[0] for c in STATE.split(", ")]
NEVER = np.iinfo(np.int64).max      # place of a return that does not come
FEW = 64                            # orders of a block go on one by one when fewer than one in so many are decided at once


def _bounds(lines, starts):
    """What ``_judge`` needs of a block besides its lines: the product of each
    line as a number, lo, unsure and later of each of these when the block
    begins, and the returns of orders outside (product, place, lo, unsure)."""
    products, code = np.unique(lines["product_id"], return_inverse=True)
    p, place = starts.column("start_product_id").to_numpy(), starts.column("start_place")
    inside = place.is_valid().to_numpy()
    at = np.minimum(np.searchsorted(products, p), len(products) - 1)
    begins, given = ~inside & (products[at] == p), inside & (products[at] == p)
    values = [starts.column(f"start_{c}").to_numpy() for c in ("lo", "unsure", "later")]
    first = [np.zeros(len(products), np.int64) for _ in values]
    for out, v in zip(first, values):
        out[at[begins]] = v[begins]
    return code, first, (at[given], place.fill_null(0).to_numpy()[given], values[0][given], values[1][given])


def _chain_on(new, verdict, orders, sell, code, at, qty, stock, back, lo, hi):
    """Carry the few orders that can be decided (``new``) on to those that wait
    for them: in order of arrival, each once, and only orders that share a
    product with one decided before.  ``lo`` and ``hi`` are each line's bounds
    without any of this; ``sell`` has the lines by product and arrival."""
    first, last = orders
    begins = np.searchsorted(code[sell], np.arange(code.max() + 2))
    owner = np.repeat(np.arange(len(first)), last - first)
    more, less = {}, {}                # quantity by product that lo has gained, hi has lost
    due: list[tuple[int, int, int, int]] = []
    queue = new.tolist()               # ascending, so a heap
    queued = np.zeros(len(first), bool)
    queued[new] = True
    while queue:
        i = heapq.heappop(queue)
        lines = range(first[i], last[i])
        while due and due[0][0] < at[first[i]]:
            _, p, a, o = heapq.heappop(due)
            more[p] -= a
            less[p] -= o
        if any(lo[k] + more.get(code[k], 0) + qty[k] > stock[k] for k in lines):
            verdict[i] = 2
        elif all(hi[k] - less.get(code[k], 0) + qty[k] <= stock[k] for k in lines):
            verdict[i] = 1
        else:
            continue
        for k in lines:
            p, q = int(code[k]), int(qty[k])
            a, o = (q, 0) if verdict[i] == 1 else (0, q)
            if p not in more:          # the first on its product: all open orders after it may change
                more[p] = less[p] = 0
                later = owner[sell[begins[p]:begins[p + 1]]]
                for j in later[(later > i) & (verdict[later] == 0) & ~queued[later]].tolist():
                    queued[j] = True
                    heapq.heappush(queue, j)
            more[p] += a
            less[p] += o
            if back[k] != NEVER:
                heapq.heappush(due, (int(back[k]), p, a, o))


def _judge(lines: pa.Table, starts: pa.Table) -> pa.Table:
    """The block's open lines, the accepted ones that an open line after them
    depends on, and a line of every order rejected now.  Accepted lines of a
    product that no open line parts are one row.

    All orders are judged at once by the verdicts so far, again and again while
    that decides many; the rest of the chains is followed order by order."""
    if not lines.num_rows:
        return lines.select(_COLUMNS)
    lines = lines.sort_by([("at", "ascending"), ("product_id", "ascending")])
    at, product, qty = (lines.column(c).to_numpy() for c in ("at", "product_id", "qty"))
    # an order's lines on one product are one
    one = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (product[1:] != product[:-1])]))
    qty, lines = np.add.reduceat(qty, one), lines.take(one) if len(one) < len(at) else lines
    col = {c: lines.column(c).to_numpy() for c in ("at", "seq", "product_id", "stock")}
    at, stock = col["at"], col["stock"]
    back = lines.column("back_at").fill_null(NEVER).to_numpy()
    code, (lo0, unsure0, later0), (g_code, g_place, g_lo, g_unsure) = _bounds(col, starts)
    n = len(at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n)
    owner = np.repeat(np.arange(len(first)), last - first)
    verdict = np.where(pc.equal(lines.column("st"), ACCEPTED).to_numpy()[first], 1, 0)    # 0 open, 1 accepted, 2 rejected
    # a line uses its quantity from its place on, up to its return or that of orders outside
    returns = np.flatnonzero(back != NEVER)
    e_code = np.concatenate([code, code[returns], g_code])
    e_place = np.concatenate([at, back[returns], g_place])
    e_order = np.lexsort((np.arange(len(e_code)) >= n, e_place, e_code))
    e_first = np.flatnonzero(np.concatenate([[True], np.diff(e_code[e_order]) != 0]))
    e_size = np.diff(np.append(e_first, len(e_order)))
    e_line = e_order < n
    sell = e_order[e_line]             # lines by product and arrival

    def before(line_value, outside, begin):
        """Sum of the events of each line's product before it."""
        e = np.concatenate([line_value, -line_value[returns], outside])[e_order]
        e = np.cumsum(e) - e
        e += np.repeat(begin - e[e_first], e_size)       # products are numbered in the order of events
        out = np.empty(n, np.int64)
        out[sell] = e[e_line]
        return out

    while True:
        v = verdict[owner]
        lo = before(np.where(v == 1, qty, 0), g_lo, lo0)
        hi = lo + before(np.where(v == 0, qty, 0), g_unsure, unsure0)
        short = np.logical_or.reduceat(lo + qty > stock, first)
        fits = np.logical_and.reduceat(hi + qty <= stock, first)
        new = np.flatnonzero((verdict == 0) & (short | fits))
        if len(new) * FEW < len(first):
            if len(new):
                _chain_on(new, verdict, (first, last), sell, code, at, qty, stock, back, lo, hi)
            break
        verdict[new] = np.where(short[new], 2, 1)

    v = verdict[owner]
    asked = np.where(v == 0, qty, 0)[sell]
    s_code = code[sell]
    s_first = np.flatnonzero(np.concatenate([[True], s_code[1:] != s_code[:-1]]))
    s_size = np.diff(np.append(s_first, n))
    through = np.cumsum(asked)
    total = np.add.reduceat(asked, s_first)
    after = np.repeat(total + later0, s_size) - (through - np.repeat(through[s_first] - asked[s_first], s_size))
    needed = sell[(v[sell] == 1) & (after > 0)]
    # accepted lines of a product without an open one between them, by return: the last of them stands for all
    opens = np.empty(n, np.int64)
    opens[sell] = np.cumsum(v[sell] == 0)
    run = np.lexsort((at[needed], back[needed], opens[needed], code[needed]))
    needed = needed[run]
    new_run = np.ones(len(needed) + 1, bool)
    for x in (code, opens, back):
        new_run[1:-1] &= x[needed[1:]] == x[needed[:-1]]
    new_run[1:-1] = ~new_run[1:-1]
    ends = np.flatnonzero(new_run)
    standing = needed[ends[1:] - 1]
    qty = qty.copy()
    if len(needed):
        qty[standing] = np.add.reduceat(qty[needed], ends[:-1])
    kept = np.concatenate([np.flatnonzero(v == 0), first[verdict == 2], standing])
    st = pa.array([OPEN, ACCEPTED, REJECTED]).take(pa.array(v[kept]))
    return pa.table({"at": at[kept], "seq": col["seq"][kept], "product_id": col["product_id"][kept], "qty": qty[kept],
                     "stock": stock[kept], "back_at": pa.array(back[kept], pa.int64(), mask=back[kept] == NEVER), "st": st})


def judge_blocks(state: DataFrame, width: int, older: DataFrame | None = None) -> DataFrame:
    """One round over ``state`` (STATE, st in {A, O}) in blocks of ``width``
    places; the next state, with a line of every order that it rejects.
    ``older``: (product_id, at, qty) that orders outside return at a place."""
    block = lambda place: F.floor(F.col(place) / F.lit(width)).cast("long")
    state = state.withColumn("blk", block("at"))
    used = F.when(F.col("st") == ACCEPTED, F.col("qty")).otherwise(F.lit(0))
    asked = F.when(F.col("st") == OPEN, F.col("qty")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    taken = state.select("blk", "product_id", used.alias("a"), asked.alias("o"), asked.alias("open"), F.lit(1).alias("lines"))
    back = state.filter(F.col("back_at").isNotNull()).select(
        block("back_at").alias("blk"), "product_id", F.col("back_at").alias("place"), (-used).alias("a"), (-asked).alias("o"),
        (F.col("blk") == block("back_at")).alias("own"))
    if older is not None:
        back = back.unionByName(older.select(block("at").alias("blk"), "product_id", F.col("at").alias("place"),
                                             (-F.col("qty")).alias("a"), none.alias("o"), F.lit(False).alias("own")))
    totals = (taken.unionByName(back.select("blk", "product_id", "a", "o", none.alias("open"), F.lit(0).alias("lines")))
              .groupBy("product_id", "blk").agg(*[F.sum(c).alias(c) for c in ("a", "o", "open", "lines")]))
    before = Window.partitionBy("product_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("product_id").orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    starts = totals.select(
        "blk", "product_id", F.lit(None).cast("long").alias("place"), *[
            F.coalesce(F.sum(c).over(w), none).alias(name)
            for c, w, name in (("a", before, "lo"), ("o", before, "unsure"), ("open", through, "later"))], "lines")
    given = (back.filter(~F.col("own")).groupBy("blk", "product_id", "place")
             .agg(F.sum("a").alias("lo"), F.sum("o").alias("unsure")).withColumn("later", none))
    starts = starts.filter(F.col("lines") > 0).drop("lines").unionByName(given)
    # columns of their own: a cogroup takes those that both sides share for the same
    starts = starts.select(F.col("blk").alias("start_blk"), *[F.col(c).alias(f"start_{c}") for c in starts.columns[1:]])
    return state.groupBy("blk").cogroup(starts.groupBy("start_blk")).applyInArrow(_judge, STATE)


def wider(state: DataFrame, width: int, limit: int, least: int = 1) -> int:
    """``width`` doubled as often as no block of ``state`` then holds more than
    ``limit`` lines and ``least`` blocks are left; halved while one holds more
    now (a count a block comes to the driver)."""
    while True:
        sizes = dict(state.groupBy(F.floor(F.col("at") / F.lit(width)).cast("long").alias("blk")).count().collect())
        if width == 1 or max(sizes.values()) <= limit:
            break
        width = -(-width // 2)
    while len(sizes) > 1:
        merged: dict[int, int] = {}
        for blk, n in sizes.items():
            merged[blk // 2] = merged.get(blk // 2, 0) + n
        if max(merged.values()) > limit or len(merged) < least:
            break
        sizes, width = merged, 2 * width
    return width


def first_width(lines: int, places: int, parallel: int, limit: int) -> int:
    """Places a block in the first round: blocks for ``parallel`` tasks at
    least, none of more than about half of ``limit`` lines."""
    blocks = max(parallel, -(-2 * lines // max(limit, 1)), 1)
    return max(1, places // blocks)
