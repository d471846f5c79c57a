"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``num / den``.  The join finds every link's component.

1. Documents with the same set form a class (128-bit set hash).
2. A set is cut into blocks by the hash of its shingles, so many blocks that
   two sets within the threshold share at least one non-empty block whole
   (the shingles they differ in are too few to touch them all).  Blocks are
   the matrix's tokens.  Equal blocks are next to unheard of between texts
   that are not near copies, so frequent words, lines and passages make no
   candidates, and the candidates grow with the links.
3. Classes that share a block with another are partitioned into groups of
   similar documents: by a widely held block of theirs, in chunks of bounded
   size.  A group stores the union of its members' shingles.
4. Token-group matrix: block -> groups.  Groups that share as many blocks as
   a link needs meet; a
   query of one is checked against the other's union first, and the group is
   opened (exact intersections with every member) only where the bound on the
   overlap qualifies.
5. Before that, the chunks of a label that was split meet the label's most
   central class alone.  What links to it is one component already, so groups
   of it never meet each other: a hot family costs as many steps as chunks.
6. Components of the links by min-label propagation with pointer jumping.

Why no link is lost: sizes a <= b link only if b <= a den/num, so both lie in
one size band or in neighbouring ones; each pair of neighbouring bands has its
own cut into k + 1 + e blocks, where k is the largest possible difference
(den - num)(a + b)/(den + num).  At least 1 + e blocks are equal; a set with
more than e empty blocks is cut again by other hashes (three cuts, then one
block for all such sets).

Copies inside a task are dropped before the shuffle.  A bucket of block keys
holds about ``BUCKET_KEYS`` of them, by count.  Joins whose key may be hot (a
class, label or component) are plain ones that adaptive execution splits by
measured size, so no table is copied for the sake of a few keys.  Sets are not stored:
a task makes them from the text where they are needed, and only those of
classes with a shared block are shuffled.  Nothing but counts and Bloom
filters of bounded size reaches the driver.

Defined results: a null or empty text, or one without words, has size 0,
links with nothing and is its own component; a text of fewer words than a
shingle is one shingle; repeated rows link with each other; documents with a
null doc_id take part, and a component of such alone has the null id; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table
from .textnum import Block, blocks, give_back, map_blocks, mix64
from .url_filter import Level

CUTS = 3
GROUP_DOCS, GROUP_TOKENS = 64, 1 << 18
BUCKET_KEYS = 1 << 19
FILTER_BITS = 1 << 26
#: Bytes of text, and block keys, that a task works on at a time.
TEXT_BYTES, SEND_KEYS = 1 << 18, 1 << 18
_SALT = [np.uint64(x) for x in (0x0123456789ABCDEF, 0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B, 0x510E527FADE682D1,
                                0x9B05688C2B3E6C1F)]


class Bands:
    """Size bands and the cut of each pair of neighbouring bands."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [0]  # the largest size of each band, from band 0 (no size)
        self.cuts: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.tops, n))

    def cut(self, j: int) -> tuple[int, int]:
        """(blocks, empty ones that are allowed) of bands j and j + 1; 0 blocks if only equal sets link."""
        if j not in self.cuts:
            self.band(self.tops[-1] + 1)
            while len(self.tops) < j + 2:
                self.band(self.tops[-1] + 1)
            top, low = self.tops[j], (self.tops[j - 1] + 1 if j else 0)
            a_b = top + min(self.tops[j + 1], top * self.den // self.num)
            k = (self.den - self.num) * a_b // (self.den + self.num)
            e = 1
            while e < k + 8:
                mean = (k + 1 + e) * math.exp(-low / (k + 1 + e))
                if e >= mean + 3 * math.sqrt(mean):
                    break
                e += 1
            self.cuts[j] = (k + 1 + e, e) if k else (0, 0)
        return self.cuts[j]

    def differ(self, n: int, j: int) -> int:
        """How many shingles a set of size ``n`` and one that it links with in
        the bands j and j + 1 differ in at most."""
        largest = min(self.tops[j + 1], n * self.den // self.num)
        return (self.den - self.num) * (n + largest) // (self.den + self.num)


def block_keys(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The block keys of a sorted set of shingle hashes, and for each how many
    blocks of its cut a linked set shares at least: all that are not empty but
    one for each shingle that the two may differ in at this set's own size."""
    out, needs, j = [], [], bands.band(len(tokens))
    for instance in (j - 1, j):
        blocks, spare = bands.cut(instance)
        if not blocks:
            continue
        for seed in range(CUTS + 1):
            if seed == CUTS:
                out.append(mix64(np.array([instance], np.uint64) ^ _SALT[4]))
                needs.append(np.ones(1, np.uint16))
                break
            t = tokens if seed == 0 else np.sort(mix64(tokens ^ _SALT[seed]))
            part = ((t >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place = part[at] + np.uint64((instance * CUTS + seed) << 32)
            out.append(mix64(np.add.reduceat(mix64(t ^ _SALT[3]), at) ^ mix64(place)))
            need = len(at) - bands.differ(len(tokens), instance) if seed == 0 else 1
            needs.append(np.full(len(at), min(max(1, need), 65535), np.uint16))
            if blocks - len(at) <= spare:
                break
    return (np.concatenate(out), np.concatenate(needs)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))


def text_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    block = Block(texts, lower=True)
    hashes = block.word_hashes()
    at, runs = block.shingles(width, hashes)
    bounds = np.searchsorted(block.doc[at], np.arange(block.n + 1)) if len(at) else np.zeros(block.n + 1, int)
    words = np.searchsorted(block.doc, np.arange(block.n + 1))
    out = []
    for i in range(block.n):
        if 0 < block.n_words[i] < width:  # the whole sequence is one shingle
            h = np.uint64(block.n_words[i])
            for x in hashes[words[i]:words[i + 1]]:
                h = mix64(np.array([h ^ x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.unique(runs[bounds[i]:bounds[i + 1]]))
    return out


def _class(tokens: np.ndarray) -> tuple[int, int]:
    if not len(tokens):
        return 0, 0
    a, b = mix64(tokens).sum(dtype=np.uint64), mix64(tokens ^ _SALT[2]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def scan(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, h1, h2 (class) of each document.  ``docs``: doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = text_sets(part.column("text"), width)
        classes = [_class(t) for t in sets]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()),
             pa.array([c[0] for c in classes], pa.int64()), pa.array([c[1] for c in classes], pa.int64())],
            names=["doc_id", "n", "h1", "h2"])
    return map_blocks(docs, run, f"doc_id {kind}, n bigint, h1 bigint, h2 bigint", size=TEXT_BYTES)


def block_rows(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Block keys by bucket of their hash, many to a row: keys, and for each
    run of them of one class and need these and the length.  A class that a
    task has met before is left out.  ``docs``: text."""
    def run(batches):
        bands, met = Bands(num, den), set()
        keys, needs, owners, held = [], [], [], 0
        for batch in batches:
            for part in blocks(batch, size=TEXT_BYTES):
                for t in text_sets(part.column("text"), width):
                    c = _class(t)
                    if c in met or not len(t):
                        continue
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(c)
                    found, need = block_keys(t, bands)
                    if len(found):
                        keys.append(found)
                        needs.append(need)
                        owners.append(c[0])
                        held += len(found)
                if held > SEND_KEYS:
                    yield flush(keys, needs, owners)
                    keys, needs, owners, held = [], [], [], 0
        if held:
            yield flush(keys, needs, owners)
        keys, needs, owners = [], [], []
        give_back()

    def flush(keys, needs, owners):
        need = np.concatenate(needs)
        flat, owner = np.concatenate(keys), np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        bucket = ((flat >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket, need = flat[order], owner[order], bucket[order], need[order]
        rows = {"bucket": [], "keys": [], "owners": [], "runs": [], "needs": []}
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            o, least = owner[a:b], need[a:b]
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (least[1:] != least[:-1])]))
            rows["bucket"].append(int(bucket[a]))
            rows["keys"].append(flat[a:b].tobytes())
            rows["needs"].append(least[first].tobytes())
            rows["owners"].append(o[first].tobytes())
            rows["runs"].append(np.diff(np.append(first, b - a)).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary())
                                           for k, v in rows.items()})
    return docs.select("text").mapInArrow(run, "bucket int, keys binary, owners binary, runs binary, needs binary")


def shared_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """(key, h1, holders, need) of every block key that two classes or more
    have: a row a class, and how many have it.  A task holds one bucket at a time."""
    def run(batches):
        now, keys, owners, needs = None, [], [], []
        for batch in batches:
            columns = (_views(batch.column(c), kind) for c, kind in (
                ("keys", np.uint64), ("owners", np.int64), ("runs", np.uint32), ("needs", np.uint16)))
            for bucket, k, o, many, least in zip(batch.column("bucket").to_pylist(), *columns):
                if bucket != now:
                    yield from out(keys, owners, needs)
                    now, keys, owners, needs = bucket, [], [], []
                needs.append(np.repeat(least, many))
                keys.append(k)
                owners.append(np.repeat(o, many))
        yield from out(keys, owners, needs)
        keys, owners, needs = [], [], []
        give_back()

    def out(keys, owners, needs):
        if not keys:
            return
        key, h1, need = np.concatenate(keys), np.concatenate(owners), np.concatenate(needs)
        order = np.argsort(key, kind="stable")
        key, h1, need = key[order], h1[order], need[order]
        same = key[1:] == key[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, h1, need = key[several], h1[several], need[several]
        order = np.lexsort((h1, key))
        key, h1, need = key[order], h1[order], need[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])])[:len(key)]
        key, h1, need = key[new], h1[new], need[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        holders = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        several = holders > 1
        if several.any():
            yield pa.RecordBatch.from_pydict({"key": key[several].astype(np.int64), "h1": h1[several],
                                              "holders": holders[several].astype(np.int64),
                                              "need": need[several].astype(np.int64)})
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "key bigint, h1 bigint, holders bigint, need bigint")


def enough_shared(shared: DataFrame) -> DataFrame:
    """``shared`` without the keys of classes that share fewer blocks with all
    others together than a link needs, and without keys that are then held once."""
    alike = Window.partitionBy("h1", "need")  # the keys of a class's cut, or of two cuts of equal need
    alive = cut(shared.withColumn("_n", F.count(F.lit(1)).over(alike)).where("_n >= need").drop("_n", "holders"))
    held = alive.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    return cut(alive.join(held, "key").select("key", "h1", "holders", "need"))


def _overlaps(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    return np.bincount(owner[query[at] == tokens], minlength=n)


def _views(tokens: pa.Array, kind: type = np.uint64) -> list[np.ndarray]:
    """The sets (numbers of ``kind``) in the batch's own memory."""
    _, offsets, data = tokens.buffers()
    if data is None or not len(tokens):
        return [np.zeros(0, kind)] * len(tokens)
    ends, wide = np.frombuffer(offsets, np.int32)[tokens.offset:tokens.offset + len(tokens) + 1].tolist(), kind().itemsize
    return [np.frombuffer(data, kind, (b - a) // wide, a) if b > a else np.zeros(0, kind)
            for a, b in zip(ends, ends[1:])]


def verify(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links between the members of ``left`` and of ``right`` (arrays
    of struct(m, star, tokens)); right null: among the members of left.
    Members with the same star are one component already."""
    def members(column):
        flat = column.values
        m, star = flat.field("m").to_numpy(), flat.field("star").to_numpy(zero_copy_only=False)
        sets = _views(flat.field("tokens"))
        return column.offsets.to_numpy(), m, star, sets

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            lo, lm, ls, lt = members(left)
            ro, rm, rs, rt = members(right)
            alone = right.is_null().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                q = range(lo[i], lo[i + 1])
                g, gm, gs, gt = (q, lm, ls, lt) if alone[i] else (range(ro[i], ro[i + 1]), rm, rs, rt)
                sizes = np.array([len(gt[x]) for x in g])
                tokens = np.concatenate([gt[x] for x in g])
                owner = np.repeat(np.arange(len(g)), sizes)
                union, least = np.unique(tokens), sizes.min()
                ids = gm[g[0]:g[-1] + 1]
                stars = gs[g[0]:g[-1] + 1]
                a, b = [], []
                for x in q:
                    t = lt[x]
                    # the overlap with any member is at most that with the union
                    at = np.minimum(np.searchsorted(union, t), len(union) - 1)
                    bound = int((union[at] == t).sum())
                    if bound * (den + num) < num * (len(t) + least):
                        continue
                    both = _overlaps(t, tokens, owner, len(g))
                    hit = den * both >= num * (len(t) + sizes - both)
                    hit &= ids > lm[x] if alone[i] else ids != lm[x]
                    hit &= ~((stars == ls[x]) & (stars >= 0))
                    a += [lm[x]] * int(hit.sum())
                    b += ids[hit].tolist()
                if a:
                    # one component needs a chain, not all its pairs
                    a, b = _forest(a, b)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        give_back()
    return pairs.select("left", "right").mapInArrow(run, "a bigint, b bigint")


def _forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Links that leave the same components as (a, b)."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    out = []
    for x, y in zip(a, b):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[rx] = ry
            out.append((x, y))
    return [x for x, _ in out], [y for _, y in out]


def components(links: DataFrame) -> DataFrame:
    """(m, root) of every node of ``links`` (a, b): the least node it reaches."""
    both = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "m"))
    while True:
        seen = both.join(labels.withColumnRenamed("m", "b"), "b")
        near = seen.groupBy(F.col("a").alias("m")).agg(F.min("root").alias("near"))
        step = labels.join(near, "m").select("m", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("m").alias("root"), F.col("root").alias("next"))
        moved = cut(step.join(jump, "root", "left")
                    .select("m", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        if not moved.where("root <> old").limit(1).count():
            return moved.select("m", "root")
        labels = moved.select("m", "root")


def _blobs(members: DataFrame, *by: str) -> DataFrame:
    return members.groupBy(*by).agg(F.collect_list(F.struct("m", "star", "tokens")).alias("docs"))


def _key_filter(keys: DataFrame) -> Level:
    """A Bloom filter of ``keys`` (key) of at most ``FILTER_BITS`` bits."""
    found = Level(0, 1, 0.02)
    found.m = min(FILTER_BITS, max(64, 9 * keys.count()))
    return found.build(keys)


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (h1, h2, doc_id of a document of the class ...) plus
    tokens, made again from the texts that a filter of doc_ids lets through."""
    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    wanted = _key_filter(members.select(name("doc_id").alias("key")))

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        got = text_sets(part.column("text"), width)
        keys = [_class(t) for t in got]
        return pa.RecordBatch.from_pydict({
            "h1": pa.array([k[0] for k in keys], pa.int64()), "h2": pa.array([k[1] for k in keys], pa.int64()),
            "tokens": pa.array([t.tobytes() for t in got], pa.binary())})
    again = map_blocks(docs.where(wanted.holds(name("doc_id"))).select("text"), sets,
                       "h1 bigint, h2 bigint, tokens binary", size=TEXT_BYTES)
    return members.join(again.dropDuplicates(["h1", "h2"]), ["h1", "h2"])


def jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, and class (h1, h2) of every document."""
    d = pick(docs, doc_id=doc_id, text=text)
    scanned = cut(scan(d, width))
    # a set has about so many blocks as shingles may differ, in each of two cuts
    sizes = scanned.agg(F.sum("n"), F.count(F.lit(1))).first()
    keys = (sizes[0] or 0) * 4 * (den - num) / (den + num) + 8 * sizes[1]
    buckets = max(1, math.ceil(keys / BUCKET_KEYS))
    shared = enough_shared(shared_blocks(block_rows(d, width, num, den, buckets), buckets))
    classes = scanned.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"))
    # a class's first label is its most widely held block; a block's is the
    # most widely held first label among its holders, so that a class without
    # its family's top block comes to the same label as the others
    held = F.struct("holders", "key")
    first = shared.groupBy("h1").agg(F.sum("holders").alias("central"), F.max(held).alias("top"))
    canon = (shared.join(first.select("h1", "top"), "h1").groupBy("key")
             .agg(F.max("top")["key"].alias("label")))
    near = (first.select("h1", "central", F.col("top.key").alias("key")).join(canon, "key")
            .select("h1", "central", "label"))
    found = cut(classes.join(near, "h1")).withColumn("m", F.monotonically_increasing_id())

    # groups: chunks of a label, by hash
    labels = found.groupBy("label").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("chunks"),
        F.max_by("m", F.struct("central", "m")).alias("leader"))
    members = cut(found.join(labels, "label").withColumn(
        "chunk", F.pmod(F.xxhash64("m"), F.col("chunks"))).withColumn("star", F.lit(-1).cast("bigint")))

    # the chunks of a split label against its most central class
    split = _with_sets(d, members.where("chunks > 1"), width)
    leaders = _blobs(split.where("m = leader"), "label").withColumnRenamed("docs", "right")
    chunks = _blobs(split, "label", "chunk").withColumnRenamed("docs", "left")
    rays = cut(verify(chunks.join(leaders, "label"), num, den))
    starred = rays.select(F.col("a").alias("m"), F.col("b").alias("_star")).distinct()
    members = cut(members.join(starred, "m", "left").withColumn("star", F.coalesce(
        "_star", F.when((F.col("m") == F.col("leader")) & (F.col("chunks") > 1), F.col("m")), F.lit(-1)))
        .drop("_star").withColumn("g", F.xxhash64("label", "star", "chunk")))

    # matrix: block -> groups; groups that share a block and are not one star
    matrix = (shared.join(members.select("h1", "g", "star", "n"), "h1")
              .groupBy("key", "g", "star").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                               F.min("need").alias("need")))
    x, y = matrix.alias("x"), matrix.alias("y")
    meet = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") < F.col("y.g"))
                  & ((F.col("x.star") != F.col("y.star")) | (F.col("x.star") < 0))
                  & (F.col("x.lo") * num <= F.col("y.hi") * den) & (F.col("y.lo") * num <= F.col("x.hi") * den))
    size = members.groupBy("g").agg(F.sum("n").alias("size"))
    # bound: a link needs so many equal blocks, and these are all the groups share
    two = (meet.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b"))
           .agg(F.count(F.lit(1)).alias("_n"), F.min("x.need").alias("_a"), F.min("y.need").alias("_b"))
           .where("_n >= greatest(_a, _b)").select("a", "b"))
    two = (two.join(size.select(F.col("g").alias("a"), F.col("size").alias("_a")), "a")
           .join(size.select(F.col("g").alias("b"), F.col("size").alias("_b")), "b"))
    less = F.col("_a") <= F.col("_b")  # the smaller group is carried to the larger one
    pairs = cut(two.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("g"),
                           F.when(less, F.col("b")).otherwise(F.col("a")).alias("other")))

    # the opened groups with their sets, a row a group
    blobs = cut(_blobs(_with_sets(d, members, width), "g"))
    involved = _key_filter(pairs.select(F.explode(F.array("g", "other")).alias("key")).distinct())
    opened = blobs.where(involved.holds(F.col("g")))
    across = (pairs.join(opened.withColumnRenamed("docs", "left"), "g")
              .join(opened.select(F.col("g").alias("other"), F.col("docs").alias("right")), "other"))
    kind = blobs.schema["docs"].dataType
    within = blobs.where((F.size("docs") > 1) & (F.col("docs")[0]["star"] < 0)).select(
        F.col("docs").alias("left"), F.lit(None).cast(kind).alias("right"))
    links = rays.unionAll(verify(within.unionAll(across.select("left", "right")), num, den))

    roots = components(links)
    joined = members.select("m", "h1", "h2", "doc_id").join(roots, "m", "left").withColumn(
        "root", F.coalesce("root", "m"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    merged = joined.join(least, "root").select("h1", "h2", F.col("component_id").alias("_far"))
    own = classes.select("h1", "h2", F.col("doc_id").alias("_own"))
    by_class = own.join(merged, ["h1", "h2"], "left").select(
        "h1", "h2", F.coalesce("_far", "_own").alias("component_id"))
    out = scanned.join(by_class, ["h1", "h2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h1", "h2")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id")
