"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become whole numbers, so that scores (inner products) are exact.
They are dealt into shards by a hash of the row; a shard keeps, for every
dimension, its rows sorted by that component.  For an anchor the lists are
read in parallel, from the top where the anchor's component is positive and
from the bottom where it is negative (sorted access).  A row met for the first
time is scored whole (random access).  The sum over all lists of the anchor's
component times the value last read, the threshold, bounds every row not yet
met; a window is closed once the threshold falls strictly below its kth score,
or below its least allowed score, so ties at the kth place are all met.

Plan: anchors, packed per ``ANCHORS`` of them, meet every shard as Spark
groups (shard, anchor group); each returns the k best of each window, and a
window function per anchor merges them.  No task holds more than one shard and
one group of anchors; both have a size that does not grow with the table.
Two passes: the first finds the positives, the second the negatives of every
positive's score window.

Defined results: rows with a null id, label or vector, or with a null, NaN or
infinite component take no part; an empty vector has score 0 with every row,
and a shorter vector counts as filled up with zeros; repeated rows are rows of
their own (a copy of an anchor is an *other* row, and is an anchor itself);
equal scores go by vec_id; a positive score below 0 leaves an empty window;
scores beyond 64 bits fail the query; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored, table, with_row_id

SHARD_ROWS = 4096
ANCHORS = 1024
FIRST_DEPTH = 32
INDEX = "shard int, dims int, uids binary, ids binary, labels binary, values binary, lists binary"


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """uid, vec_id, label, q: the rows that take part, components as floor(256 x)."""
    d = pick(rows, vec_id=vec_id, label=label, vector=vector)
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    return with_row_id(d.select("vec_id", F.col("label").cast("bigint").alias("label"), F.transform(
        "vector", lambda x: F.floor(x.cast("double") * 256).cast("bigint")).alias("q")))


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _vectors(column) -> list[np.ndarray]:
    return [np.asarray(v, np.int64) for v in column.to_pylist()]


def build_lists(vectors: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its rows and, per dimension, their order by that component."""
    def build(key, group):
        vs = _vectors(group.column("q"))
        q = _matrix(vs, max(map(len, vs)))
        lists = np.argsort(q, axis=0, kind="stable").T.astype(np.int32)
        cols = {"uids": group.column("uid"), "ids": group.column("vec_id"), "labels": group.column("label")}
        row = {name: [col.to_numpy().astype(np.int64).tobytes()] for name, col in cols.items()}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([q.shape[1]], pa.int32()), **row,
                         "values": [q.tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]})
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, INDEX)


class Lists:
    """A shard's rows and sorted lists, with the threshold algorithm over them."""

    def __init__(self, row: dict):
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "labels"))
        self.n = len(self.uids)
        self.q = np.frombuffer(row["values"], np.int64).reshape(self.n, row["dims"])
        self.up = np.frombuffer(row["lists"], np.int32).reshape(row["dims"], self.n)
        self.down = self.up[:, ::-1]
        self.top = int(np.abs(self.q).max(initial=0))
        self.as_float = self.q.astype(float)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; in doubles only while every sum stays a whole number below 2^53."""
        most = self.top * int(np.abs(anchor).sum(dtype=object)) if len(anchor) else 0
        if most < 1 << 53:
            return (self.as_float[rows] @ anchor.astype(float)).astype(np.int64)
        if most < 1 << 63:
            return self.q[rows] @ anchor
        return (self.q[rows].astype(object) @ anchor.astype(object)).astype(np.int64)  # fails if it does not fit

    def search(self, anchor: np.ndarray, windows: list[tuple[np.ndarray, int, int | None, int | None]]) -> list[np.ndarray]:
        """For each window (allowed rows, k, least and greatest score): its best
        rows, by score, then id.  Also returns the scores (last item) and sets
        ``met``, the number of rows scored."""
        width = min(len(anchor), self.q.shape[1])
        a = np.zeros(self.q.shape[1], np.int64)
        a[:width] = anchor[:width]
        used = np.flatnonzero(a)
        rising = (a[used] > 0)[:, None]
        score = np.zeros(self.n, np.int64)
        met = np.zeros(self.n, bool)
        waiting = [w for w in windows if w[2] is None or w[3] is None or w[2] <= w[3]]
        depth = 0
        while waiting and depth < self.n:
            upto = min(self.n, max(FIRST_DEPTH, 2 * depth)) if len(used) else self.n
            now = met.copy()
            if upto == self.n:
                now[:] = True
            else:
                now[np.where(rising, self.down[used, depth:upto], self.up[used, depth:upto])] = True
            new = np.flatnonzero(now & ~met)
            score[new] = self.scores(new, a)
            met, depth = now, upto
            last = np.where(rising[:, 0], self.down[used, depth - 1], self.up[used, depth - 1])
            threshold = sum(int(x) * int(y) for x, y in zip(a[used], self.q[last, used]))
            waiting = [w for w in waiting if not self._closed(w, threshold, score, met)]
        self.met = int(met.sum())
        out = []
        for window in windows:
            rows = np.flatnonzero(self._inside(window, score, met))
            out.append(rows[np.lexsort((self.ids[rows], -score[rows]))][:window[1]])
        return out + [score]

    @staticmethod
    def _inside(window, score, met) -> np.ndarray:
        allowed, _, least, most = window
        ok = met & allowed
        if least is not None:
            ok &= score >= least
        return ok if most is None else ok & (score <= most)

    def _closed(self, window, threshold: int, score, met) -> bool:
        _, k, least, _ = window
        if least is not None and threshold < least:
            return True
        have = score[self._inside(window, score, met)]
        return len(have) >= k and threshold < int(np.partition(have, len(have) - k)[len(have) - k])


def _meet(index: DataFrame, anchors: DataFrame, shards: int, n_anchors: int, body, schema: str) -> DataFrame:
    """``body(lists, anchor row) -> rows`` for every shard and anchor, in groups of both."""
    groups = max(1, math.ceil(n_anchors / ANCHORS))
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(one, many):
        rows = []
        if one.num_rows and many.num_rows:
            lists = Lists(one.to_pylist()[0])
            for anchor in many.to_pylist():
                rows.extend(body(lists, anchor))
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, schema)


def _best(df: DataFrame, keys: tuple[str, ...], score: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(vec_id))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10,
         least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: uid, vec_id, label, q (see ``whole_vectors``); ``anchors``:
    some of these rows.  Positives are the best rows of the anchor's label;
    the negatives of a positive are the best rows of other labels whose score
    lies between the two shares of the positive's score.
    """
    size, n_anchors = vectors.count(), anchors.count()
    shards = max(1, math.ceil(size / SHARD_ROWS))
    index = stored(build_lists(vectors, shards))

    def positives(lists: Lists, row: dict):
        same = (lists.labels == row["label"]) & (lists.uids != row["uid"])
        rows, score = lists.search(np.array(row["q"], np.int64), [(same, n_positives, None, None)])
        return [(row["uid"], int(lists.ids[i]), int(lists.uids[i]), int(score[i])) for i in rows]

    found = _best(_meet(index, anchors, shards, n_anchors, positives, "uid long, positive_id long, positive_uid long, positive_score long"),
                  ("uid",), "positive_score", "positive_id", n_positives)
    pairs = stored(found.groupBy("uid").agg(F.sort_array(F.collect_list(
        F.struct(F.col("rank").cast("bigint").alias("slot"), "positive_id", "positive_score"))).alias("positives")))
    asked = anchors.join(pairs, "uid")

    def negatives(lists: Lists, row: dict):
        other = lists.labels != row["label"]
        windows = [(other, n_negatives, -(-least_percent * p["positive_score"] // 100), most_percent * p["positive_score"] // 100)
                   for p in row["positives"]]
        *best, score = lists.search(np.array(row["q"], np.int64), windows)
        return [(row["uid"], p["slot"], int(lists.ids[i]), int(score[i])) for p, rows in zip(row["positives"], best) for i in rows]

    mined = _best(_meet(index, asked, shards, n_anchors, negatives, "uid long, slot long, negative_id long, negative_score long"),
                  ("uid", "slot"), "negative_score", "negative_id", n_negatives)
    chosen = pairs.join(anchors.select("uid", "vec_id"), "uid").select(
        "uid", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select(
        "uid", "anchor_id", F.col("p.slot").alias("slot"), "p.positive_id", "p.positive_score")
    return chosen.join(mined, ["uid", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whole_vectors(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    d = d.withColumn("label", label)
    return mine(d, d.where("vec_id % 100 = 0"))


OP13_SQL = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM rows),
scored AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label AS alabel, b.rid AS brid, b.vec_id AS bid, b.label AS blabel,
                  CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
pos AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, bid) AS slot FROM scored WHERE alabel = blabel),
neg AS (SELECT p.arid, p.slot, p.anchor_id, p.bid AS positive_id, p.score AS positive_score, n.bid AS negative_id,
               n.score AS negative_score,
               row_number() OVER (PARTITION BY p.arid, p.slot ORDER BY n.score DESC, n.bid) AS rank
        FROM pos p JOIN scored n ON n.arid = p.arid AND n.blabel <> n.alabel
         AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        WHERE p.slot <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
