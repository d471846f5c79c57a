"""Line dedup by site-relative frequency.

Documents are grouped by host.  The share of a host's pages that contain a
line is that line's ratio; lines above ``max_ratio`` on at least
``min_pages`` pages are the host's boilerplate and are dropped from all its
pages, every occurrence.

Plan: distinct lines of each page are counted as (host, 64-bit line hash)
with map-side sums, so a hot host or line arrives as one partial count a
task.  A host has at most (mean lines a page / max_ratio) boilerplate lines,
which bounds the list that is joined back by host.  The lists are stored
first, so the planner knows their size: it broadcasts them under the session's
threshold, and no text moves; beyond it, adaptive execution splits a hot
host.  No line table is joined back.

Defined results: a null text stays null and counts as a page without lines;
an empty text has no lines; lines of spaces only are never dropped;
a null host is a host of its own; a page whose lines all go has the empty
text; repeated rows count as pages of their own; an empty table gives an
empty result.

With ``distinct_texts`` (op2 and the pipeline) the rows of a host with equal
texts (by 64-bit hash) count as one page, for the lines and the host's total,
so the copies of a page are no evidence of boilerplate; and a page whose lines
would all go keeps its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table

MAX_RATIO = 0.05
MIN_PAGES = 3


def boilerplate(docs: DataFrame, max_ratio: float, min_pages: int, distinct_texts: bool = False) -> DataFrame:
    """host, drop (array of line hashes) of every host that has boilerplate.
    ``docs``: host, text."""
    lines = F.array_distinct(F.transform(
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    held = docs.where("text IS NOT NULL")
    if distinct_texts:  # line hashes move, not texts; copies collapse map-side
        page = F.xxhash64("text").alias("page")
        held = held.select("host", page, lines.alias("lines")).groupBy("host", "page").agg(F.first("lines").alias("lines"))
        docs, lines = docs.select("host", page, F.col("text").isNull().alias("none")).distinct(), F.col("lines")
    seen = held.select("host", F.explode(lines).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = docs.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    c, p = counts.alias("c"), pages.alias("p")
    return (c.join(p, F.col("c.host").eqNullSafe(F.col("p.host")))
            .where(F.col("n") > F.col("pages") * F.lit(max_ratio))
            .groupBy("c.host").agg(F.sort_array(F.collect_list("line")).alias("drop")))


def dedup_lines(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES, keep: tuple[str, ...] = ("doc_id",),
                distinct_texts: bool = False) -> DataFrame:
    """The ``keep`` columns, text without boilerplate lines, n_lines, n_dropped."""
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    d = pick(docs, host=host, text="text", **names)
    lists = stored(boilerplate(d, max_ratio, min_pages, distinct_texts).withColumnRenamed("host", "_host"))
    joined = d.join(lists, F.col("host").eqNullSafe(F.col("_host")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(
        lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), F.xxhash64(x))))
    out = joined.select(*names, "text", "drop", kept.alias("_kept"))
    if distinct_texts:
        left = F.exists("_kept", lambda x: F.trim(x) != "")
        out = out.withColumn("_kept", F.when(left, F.col("_kept")).otherwise(lines))
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(lines)).cast("bigint")
    return out.select(
        *[F.col(k).alias(c) for k, c in names.items()],
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        n.alias("n_lines"),
        F.when(n == 0, 0).otherwise(n - F.size("_kept")).cast("bigint").alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), distinct_texts=True)


def dedup_sql(source: str, ratio: float = MAX_RATIO, pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the documents after line dedup: the columns of
    ``source`` with text replaced, n_lines and n_dropped."""
    return f"""
SELECT * EXCLUDE (lines, kept) REPLACE (CASE WHEN drop_ IS NULL OR text = '' THEN text ELSE array_to_string(kept, chr(10)) END AS text),
       CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(lines) - len(kept) END::BIGINT AS n_dropped
FROM (
  SELECT * REPLACE (CASE WHEN len(list_filter(kept, lambda x: trim(x) <> '')) > 0 THEN kept ELSE lines END AS kept),
         CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(lines) END::BIGINT AS n_lines
  FROM (
    SELECT d.*, b.drop_, string_split(text, chr(10)) AS lines,
           list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(b.drop_, x), false)) AS kept
    FROM {source} d LEFT JOIN (
      SELECT l.source, list(line) AS drop_
      FROM (SELECT source, line, count(*) AS n
            FROM (SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line
                  FROM (SELECT DISTINCT source, text FROM {source} WHERE text IS NOT NULL))
            GROUP BY source, line HAVING count(*) >= {pages}) l
      JOIN (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM {source}) GROUP BY source) p
        ON l.source IS NOT DISTINCT FROM p.source
      WHERE n > pages * {ratio}
      GROUP BY l.source) b ON d.source IS NOT DISTINCT FROM b.source))"""


OP2_SQL = f"SELECT doc_id, text, n_lines, n_dropped FROM ({dedup_sql('documents')})"
