"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Every whole text is searched for three base kinds (assign, access, hex) and
for bare key-like tokens.  The value of each find is hashed, and the hash is
counted over the corpus by distinct repositories and owners.  A value that
many owners hold is a copied example; one that stays with few owners and
looks live (letters and digits mixed, not one repeated character) is a
credential.  Bare tokens become spans of their own only when the count calls
them live; base spans always stay.

Hot values: a value in a third of all documents is collapsed by the map side
of the (hash, owner, repository) aggregation, and its verdict reaches its
documents through a salted join.  Texts are never shuffled.

Defined results: a null or empty text has no spans (counts 0, the hash of the
empty string); null owners and repositories count as one value each;
repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pick, salted_lookup, table, with_row_id

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below the least length fail anyway, so the length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_WORD = "[A-Za-z0-9+/_=-]"
BARE = rf"(?<!{_WORD})(?={_WORD}*[0-9])(?={_WORD}*[A-Za-z]){_WORD}{{20,}}+"
KINDS = ("assign", "access", "hex", "bare")
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,looks:boolean>>"
#: Changes of character class inside a run (the capital of a word is none).
_CHANGE = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"


def _prefix_sums(lens: Column) -> Column:
    """Running sums of an array of longs, in blocks of about the square root
    of its length, so a text with very many finds stays affordable."""
    def total(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def sums(a):
        n = F.size(a)

        def with_block(b):
            def with_heads(heads):
                return F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(
                    F.floor(i / b).cast("int"),
                    lambda q: total(F.slice(heads, F.lit(1), q)) + total(F.slice(a, q * b + 1, i - q * b + 1))))
            heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")),
                                lambda q: total(F.slice(a, q * b + 1, b)))
            return let(heads, with_heads)
        return let(F.ceil(F.sqrt(n)).cast("int"), with_block)
    return let(lens, sums)


def looks_live(value: Column, bare: bool) -> Column:
    """Whether a value looks like a key and not like a placeholder (nor, if ``bare``, a path or slug)."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 5)
    if not bare:
        return mixed
    return mixed & F.exists(F.split(value, "[^A-Za-z0-9]+"), lambda run: (F.length(run) >= 8) & let(
        F.regexp_count(run, F.lit(_CHANGE)), lambda n: (n >= 2) & (n * 5 >= F.length(run))))


def find_spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, hash of the
    group's value, whether it looks live), in code points; values shorter than
    ``least`` are dropped.

    The text between matches gives the places: a match starts where the texts
    and matches before it end.
    """
    rx = F.lit(pattern)

    def located(m):
        def placed(ends):
            values = F.regexp_extract_all(text, rx, F.lit(group)) if group else m
            return let(values, lambda v: F.filter(
                F.transform(ends, lambda e, i: F.struct(
                    (e - F.length(m[i])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"),
                    F.when(F.length(v[i]) >= least, F.sha2(v[i], 256)).alias("hash"),
                    looks_live(v[i], kind == 3).alias("looks"))),
                lambda s: s["hash"].isNotNull()))
        lens = let(F.split(text, pattern, -1), lambda gaps: F.transform(
            m, lambda x, i: (F.length(gaps[i]) + F.length(x)).cast("bigint")))
        return F.when(F.size(m) == 0, F.lit(None).cast(SPAN)).otherwise(let(_prefix_sums(lens), placed).cast(SPAN))
    return F.coalesce(let(F.regexp_extract_all(text, rx, F.lit(0)), located), F.array().cast(SPAN))


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"),
                 example_owners: int = 3, example_repos: int = 3, salts: int = 32,
                 must_look: bool = False) -> DataFrame:
    """One row a document: uid, doc_id, base (spans: start, kind, end, hash,
    looks), added (live bare spans), n_live, n_example.

    A value held by at least ``example_owners`` owners and ``example_repos``
    repositories is an example; others are live, with ``must_look`` only those
    that look it.
    """
    names = {f"_r{i}": c for i, c in enumerate(repo)}
    d = pick(docs, doc_id="doc_id", text="text", owner=owner, **names)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(find_spans(text, ASSIGN, 0, 2, 6), find_spans(text, ACCESS, 1, 0, 20),
                    find_spans(text, HEX, 2, 0, 24))
    found = d.select("doc_id", "owner", F.struct(*names).alias("repo"), base.alias("base"),
                     find_spans(text, BARE, 3, 0, 20).alias("bare"))
    found = with_row_id(found.select(
        "doc_id", "owner", "repo", "base",
        F.filter("bare", lambda b: ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        .alias("bare")))

    finds = found.where("size(base) + size(bare) > 0").select(
        "uid", "owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).select(
        "uid", "owner", "repo", "s", F.col("s.hash").alias("hash"))
    per_repo = finds.select("hash", "owner", "repo").distinct()
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    held = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    judged = salted_lookup(finds, held, "hash", "uid", salts).withColumn("example", example)
    live = ~F.col("example") & F.col("s.looks") if must_look else ~F.col("example")
    judged = judged.withColumn("live", live)
    per_doc = judged.groupBy("uid").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added"),
        F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"))
    none = F.array().cast(SPAN)
    return found.drop("bare").join(per_doc, "uid", "left").select(
        "uid", "doc_id", "base", F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mark."""
    def fold(acc, s):
        return F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                     F.lit(mark)).alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(F.array_sort(spans), start, fold, lambda a: F.concat(
        a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan_secrets(table(spark, sf_dir, "documents"), must_look=True)

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                    _written(F.concat("base", "added")).alias("spans"), "n_live", "n_example")


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN_SQL = ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
               + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
_KINDS_SQL = ((0, _ASSIGN_SQL, 2, 6), (1, "AKIA[A-Z0-9]+", 0, 20), (2, "[0-9a-f]+", 0, 24), (3, _WORD + "+", 0, 20))
_FOUND_SQL = " UNION ALL ".join(
    f"SELECT rid, {kind} AS kind, {least} AS least, regexp_extract_all(t, '{rx}', 0) AS m, "
    f"regexp_extract_all(t, '{rx}', {group}) AS v, string_split_regex(t, '{rx}') AS g FROM d"
    for kind, rx, group, least in _KINDS_SQL)
#: ``looks_live`` in SQL: pairs of neighbours instead of the places between them.
_LOOKS_SQL = """(regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 5
  AND (kind < 3 OR list_bool_or(list_transform(string_split_regex(value, '[^A-Za-z0-9]+'), lambda r: length(r) >= 8
    AND list_transform([len(list_filter(range(1, length(r)), lambda i: regexp_matches(substring(r, i, 2),
      '^([A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z])$')))], lambda n: n >= 2 AND n * 5 >= length(r))[1]))))"""
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner,
                  coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1)) AS repo FROM documents),
found AS ({_FOUND_SQL}),
lens AS (SELECT rid, kind, least, v, list_transform(m, lambda x: length(x)) AS ml, list_transform(g, lambda x: length(x)) AS gl
         FROM found WHERE len(m) > 0),
placed AS (SELECT rid, kind, least, unnest(v) AS value, unnest(ml) AS n, unnest(gl[1:len(ml)]) AS gap,
                  unnest(range(len(ml))) AS i FROM lens),
spans AS (SELECT rid, kind, least, value, n,
                 SUM(n + gap) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM placed),
kept AS (SELECT rid, kind, value, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {_LOOKS_SQL} AS looks FROM spans
         WHERE length(value) >= least AND (kind <> 3 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))),
finds AS (SELECT * FROM kept WHERE kind < 3 UNION ALL
          SELECT * FROM kept b WHERE kind = 3 AND NOT EXISTS (
            SELECT 1 FROM kept a WHERE a.rid = b.rid AND a.kind < 3 AND a.s < b.e AND b.s < a.e)),
held AS (SELECT value, count(DISTINCT owner) >= 3 AND count(DISTINCT repo) >= 3 AS example
         FROM finds JOIN d USING (rid) GROUP BY value),
written AS (SELECT rid, kind, s, example, NOT example AND looks AS live, list_extract({list(KINDS)}, kind + 1) || ':' || s || ':' || e AS span
            FROM finds JOIN held USING (value))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3 OR live), '') AS spans,
       count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example
FROM d LEFT JOIN written USING (rid) GROUP BY rid, doc_id"""
