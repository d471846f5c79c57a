"""Conversation prefix trie by ROLLUP over turn columns.

A node of the trie is a distinct sequence of first turns.  A conversation is
cut into blocks of ``WIDTH`` turns; one row a block holds the block's turns in
``WIDTH`` columns and the key of the node before it.  ``GROUP BY block, node
before, ROLLUP(t1, ..., t8)`` then aggregates all prefixes of all blocks
together, and grouping_id says how deep in its block a group lies.

A turn is known by the SHA-256 of its role and text; a node by its depth and
two 59-bit sums of hashes of (place, turn), so the node before a block needs
no walk down the trie: it is a running sum.

Subtree sums need no walk up either.  A node belongs to the least conversation
that passes it, and the nodes that a conversation owns are the end of its path
from some depth on.  So the tokens of all distinct nodes below a node are the
sums of what its members own, but that its owner counts from the node on; a
second ROLLUP takes these sums, and the leaves in the same way.

Skew: turns are ranked by a range partitioning of (conversation, turn), so a
conversation that holds a third of all turns is dealt over many tasks; running
sums go in two levels (functions.prefix); a turn, node or conversation that a
third of all rows share is collapsed on the map side of the ROLLUP.  The ids
that end in one node are joined per ``ID_CHUNK`` ids and hashed as a stream,
so no task holds a node's ids at once.

Defined results: rows with a null conv_id are left out; null role and text are
empty; turns of equal number follow by role, then text; a null turn comes
first; repeated rows are turns of their own; a conversation without turns ends
in the root; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import block_width_for, exclusive_prefix_sums
from .common import cut, pick, stored, table

WIDTH = 8
ID_CHUNK = 4096
BITS = 59  # nine numbers of so many bits still add up in a long
MASK = (1 << BITS) - 1
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ("depth", "c1", "c2")


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn key (SHA-256) and n (code points)."""
    d = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    d = d.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    order = ("conv_id", "turn", "role", "text")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = cut(d.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", key.alias("key"), F.length("text").cast("bigint").alias("n"), F.monotonically_increasing_id().alias("at")))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", "conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("many").over(earlier), F.lit(0))).drop("many")
    return placed.join(runs, ["part", "conv_id"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "key", "n")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The conversations with the head of their century's first one: conv_id,
    and place, key, n per turn (null once for a conversation without turns)."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "n"))).alias("head")).withColumnRenamed("conv_id", "base")
    plan = turns.select("conv_id").distinct().select(
        "conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    plan = plan.join(heads, "base", "left").select("conv_id", "h", F.slice(
        F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")).alias("lead"))
    plan = stored(plan.withColumn("gap", F.size("lead") - F.col("h")))
    own = turns.join(plan.select("conv_id", "h", "gap"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") + F.col("gap")).alias("place"), "key", "n")
    lead = plan.select("conv_id", F.inline_outer("lead"))
    # a conversation with own turns left needs no row without a turn
    return own.unionAll(lead.select("conv_id", "place", "key", "n"))


def block_rows(turns: DataFrame) -> DataFrame:
    """One row a conversation and block: blk, p1, p2, before (node before it and
    its tokens), t1.. (h1, h2, n), total and turns of the conversation."""
    place = F.col("place").cast("bigint")
    h1, h2 = (F.shiftrightunsigned(F.xxhash64(F.lit(i), place, F.col("key")), 64 - BITS) for i in (1, 2))
    slot = F.pmod(place - 1, F.lit(WIDTH))
    d = turns.select("conv_id", F.coalesce(F.floor((place - 1) / WIDTH), F.lit(0)).cast("bigint").alias("blk"), slot.alias("slot"),
                     F.when(place.isNotNull(), F.struct(h1.alias("h1"), h2.alias("h2"), "n")).alias("t"))
    rows = d.groupBy("conv_id", "blk").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("t"))).alias(t) for i, t in enumerate(TURNS)],
        F.count("t").alias("turns"), F.coalesce(F.sum("t.n"), F.lit(0)).alias("tokens"),
        *[F.coalesce(F.sum(F.col(f"t.{h}").cast("decimal(20,0)")), F.lit(0)).alias(f"sum_{h}") for h in ("h1", "h2")])
    rows = stored(rows)
    width = block_width_for(rows.agg(F.max("blk")).first()[0] or 0)
    rows = exclusive_prefix_sums(rows, "conv_id", "blk", {"q1": "sum_h1", "q2": "sum_h2", "before": "tokens"}, width,
                                 key_totals={"total": "tokens", "length": "turns"})
    p1, p2 = ((F.col(q) % F.lit(1 << BITS).cast("decimal(38,0)")).cast("bigint") for q in ("q1", "q2"))
    return stored(rows.select("conv_id", "blk", p1.alias("p1"), p2.alias("p2"), F.col("before").cast("bigint").alias("before"),
                              *TURNS, "total", "length"))


def _digest(c: str, h: str):
    """Node key after the turns that are not null."""
    total = F.col(c)
    for t in TURNS:
        total = total + F.coalesce(F.col(f"{t}.{h}"), F.lit(0))
    return total.bitwiseAND(F.lit(MASK))


def rolled_up(rows: DataFrame, sums: str) -> DataFrame:
    """The nodes: depth, c1, c2, q1, q2 (key of the parent), n_last, upto (tokens
    of the path before the last turn), n_convs, conv_id and ``sums``."""
    groups = rows.sparkSession.sql(f"""
        SELECT blk, p1, p2, {", ".join(TURNS)}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS level, max(before) AS before,
               count(*) AS n_convs, min(conv_id) AS conv_id {sums}
        FROM {{rows}} GROUP BY blk, p1, p2, ROLLUP({", ".join(TURNS)})""", rows=rows)
    last = F.try_element_at(F.array(*TURNS), F.when(F.col("level") > 0, F.col("level")))
    nodes = groups.withColumn("last", last).where("last IS NOT NULL OR (level = 0 AND blk = 0)")
    tokens = F.col("before")
    for t in TURNS:
        tokens = tokens + F.coalesce(F.col(f"{t}.n"), F.lit(0))
    n_last = F.coalesce(F.col("last.n"), F.lit(0))
    parent = [F.pmod(_digest(p, h) - F.col(f"last.{h}"), F.lit(1 << BITS)).alias(q)
              for p, h, q in (("p1", "h1", "q1"), ("p2", "h2", "q2"))]
    kept = [c for c in groups.columns if c not in ("blk", "p1", "p2", "level", "before", *TURNS)]
    return nodes.select((F.col("blk") * WIDTH + F.col("level")).alias("depth"), _digest("p1", "h1").alias("c1"),
                        _digest("p2", "h2").alias("c2"), *parent, n_last.alias("n_last"), (tokens - n_last).alias("upto"), *kept)


def _ends(rows: DataFrame) -> DataFrame:
    """depth, c1, c2, ends_sha256: SHA-256 of the ids that end in a node, as a stream of sorted pieces."""
    at_end = rows.where(F.col("blk") == F.greatest(F.floor((F.col("length") - 1) / WIDTH), F.lit(0)))
    pieces = at_end.select(F.col("length").alias("depth"), _digest("p1", "h1").alias("c1"), _digest("p2", "h2").alias("c2"),
                           "conv_id", F.floor(F.col("conv_id") / ID_CHUNK).alias("chunk"))
    pieces = pieces.groupBy(*NODE, "chunk").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if at != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _node_rows(done)
        yield _node_rows([] if node is None else [(*node, digest.hexdigest())])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(
        hashed, "depth bigint, c1 bigint, c2 bigint, ends_sha256 string")


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                      names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the conversations ``turns`` (conv_id, place, key, n; a
    row with a null place stands for a conversation without turns)."""
    rows = block_rows(turns)
    nodes = stored(rolled_up(rows, ""))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("c1"), F.col("q2").alias("c2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    children = stored(children)
    owners = nodes.join(children, list(NODE), "left").groupBy("conv_id").agg(
        F.sum("n_last").alias("owned"), F.count_if(F.col("n_children").isNull()).alias("leaves"))
    own = rows.join(owners, "conv_id", "left").fillna(0, ["owned", "leaves"])
    full = rolled_up(own, """, sum(total) AS totals, sum(owned) AS owned, sum(leaves) AS n_leaves,
        min_by(owned, conv_id) AS owner_owned, min_by(total, conv_id) AS owner_total""")
    # tokens that members read below the path so far, less those of distinct nodes
    saved = F.expr("(totals - n_convs * upto) - (owned - owner_owned + owner_total - upto)")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("c1").alias("q1"), F.col("c2").alias("q2"),
                      F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (full.join(children, list(NODE), "left").join(_ends(rows), list(NODE), "left")
            .join(up, ["depth", "q1", "q2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(ranked_turns(table(spark, sf_dir, "conversations"))))


#: CRC-32 of a text, bit by bit (fixed polynomial of the standard).
_CRC_SQL = """CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(t, ''),
    lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) END"""
OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, (SELECT {_CRC_SQL} FROM (SELECT CAST(conv_id AS VARCHAR) AS t)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.place, 0 AS late, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
      UNION ALL SELECT c.conv_id, t.place, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY late, place) AS depth, text,
             md5(length(role) || ':' || role || text) AS key FROM r),
path AS (SELECT conv_id, depth, length(text) AS n, string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM p
         UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
                 CASE WHEN depth > 1 THEN node[:-34] WHEN depth = 1 THEN '' END AS parent FROM path GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT a.node, sum((b.n_convs - 1) * b.n) AS saved, count(*) FILTER (WHERE kids.node IS NULL) AS leaves
          FROM nodes b JOIN path w ON w.conv_id = b.conv_id AND w.depth <= b.depth JOIN nodes a ON a.node = w.node
          LEFT JOIN kids ON kids.node = b.node GROUP BY a.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes up ON up.node = x.parent LEFT JOIN kids ON kids.node = x.node
JOIN below ON below.node = x.node LEFT JOIN ends ON ends.node = x.node"""
