"""URL filters: longest-prefix rules, then a Bloom filter cascade (DataFrame functions only).

A list of blocked hosts is checked without a join.  Level 0 of the cascade
is a Bloom filter of the listed keys; level 1 holds level 0's false
positives among all other keys of the corpus, level 2 the listed keys that
level 1 wrongly catches, and so on until a level has none.  Over the
corpus's own keys (the complete universe) the answer is therefore exact.

Sizes: a filter has about ``log2(1/fpr) / ln 2`` bits a key.  Keys are dealt
by hash into as many shards as it takes to keep each shard's filters under
``shard_bytes``; each shard is built and applied in its own pass, so what a
plan carries is bounded whatever the size of the list.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is not listed (allow).  Repeated rows give repeated rows.
An empty table gives an empty result, an empty list allows everything.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

#: (verdict, host, path): the longest rule that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host labels that make the list of the registered query.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
BITMAP_BITS = 32768  # of one bitmap_construct_agg value


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


class Level:
    """One Bloom filter: its bits, and the test of a key as a column."""

    def __init__(self, number: int, n_keys: int, fpr: float):
        self.number = number
        self.k = max(1, round(math.log2(1 / fpr)))
        self.m = max(8, math.ceil(n_keys * math.log2(1 / fpr) / math.log(2)))
        self.bits = b""

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.m)) for i in range(self.k)]

    def build(self, keys: DataFrame) -> "Level":
        pos = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("pos"))
        pages = (pos.groupBy(F.floor(F.col("pos") / BITMAP_BITS).alias("page"))
                 .agg(F.bitmap_construct_agg(F.pmod("pos", F.lit(BITMAP_BITS))).alias("bits")).collect())
        found = {r["page"]: bytes(r["bits"]) for r in pages}  # at most m / 8 bytes and a page
        blank = bytes(BITMAP_BITS // 8)
        whole = b"".join(found.get(p, blank) for p in range(-(-self.m // BITMAP_BITS)))
        self.bits = whole[:-(-self.m // 8)]
        return self

    def holds(self, key: Column) -> Column:
        data, out = F.lit(bytearray(self.bits)), None
        for pos in self.positions(key):
            byte = F.conv(F.hex(F.substring(data, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = F.bit_get(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


class Cascade:
    """Levels over one shard of the universe; ``listed(key)`` is exact on it."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, fpr: float) -> "Cascade":
        """``universe``: key, listed; one row a key, cheap to read again."""
        size = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
        members, others, levels = universe.where("listed"), universe.where("NOT listed"), []
        n, rest = size.get(True, 0), size.get(False, 0)
        while n:
            # the first level keeps its false positives about as few as its keys
            p = fpr if levels or rest == 0 else min(fpr, max(n / rest, 1e-6) / 2)
            level = Level(len(levels), n, p).build(members)
            levels.append(level)
            caught = others.where(level.holds(F.col("key")))
            members, others = caught, members
            n = caught.count()
        return cls(levels)

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.holds(key), out).otherwise(F.lit(level.number % 2 == 1))
        return out

    def size(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def in_cascade(rows: DataFrame, key: str, universe: DataFrame, out: str = "listed",
               fpr: float = 0.1, shard_bytes: int = 16 << 20) -> DataFrame:
    """``rows`` plus the boolean ``out``: is its key listed?  ``universe``
    (key, listed) has every key of ``rows`` once."""
    universe = cut(universe.select("key", "listed"))
    n = universe.where("listed").count()
    worst = n * (math.log2(1e6) + 4) / math.log(2) / 8  # bytes, all levels
    shards = max(1, math.ceil(worst / shard_bytes))

    def shard(c):
        return F.pmod(F.xxhash64(c, F.lit("shard")), F.lit(shards))
    parts = []
    for s in range(shards):
        cascade = Cascade.build(universe.where(shard("key") == s), fpr)
        part = rows.where(shard(key) == s).withColumn(out, cascade.listed(F.col(key)))
        parts.append(part if shards == 1 else cut(part))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def filter_urls(pages: DataFrame, listed_hosts: Column, rules=RULES, fpr: float = 0.1,
                shard_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page.

    ``listed_hosts``: a condition on the column ``key`` that says which hosts
    of the corpus are on the list (for a list in a table: a semi-joined
    universe can be passed to ``in_cascade`` directly).
    """
    p = pick(pages, page_id="page_id", url="url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = p.select(F.col("host").alias("key")).distinct().withColumn("listed", listed_hosts & (F.col("key") != ""))
    judged = in_cascade(p, "host", universe, "listed", fpr, shard_bytes)
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_hit", hit).select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"),
        F.coalesce(F.col("_hit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed")


def label_condition(labels=LISTED_LABELS) -> Column:
    return F.rlike(F.col("key"), F.lit(r"(^|\.)(" + "|".join(labels) + r")\."))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), label_condition())


_HOST = ("translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), "
         f"'{string.ascii_uppercase}', '{string.ascii_lowercase}')")
OP6_SQL = f"""
WITH u AS (
  SELECT page_id, {_HOST} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
m AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := r.h || r.p, verdict := r.verdict), length(r.h || r.p))
               FROM rules r
               WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS hit,
         regexp_matches(host, '(^|\\.)({"|".join(LISTED_LABELS)})\\.') AS listed
  FROM u)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM m"""
