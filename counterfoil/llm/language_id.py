"""Language ID by Bayesian evidence fusion.

The posterior of a document's language multiplies

* the text's likelihood under hashed byte trigrams, learnt from a bounded
  sample: of every declared language the texts of least hash, its share of
  ``train_rows`` of them and LEAST_ROWS at least;
* the likelihood of its declared language and of its address suffix, from
  counts of both by text language over all documents (a declaration counts by
  its primary subtag, lowered: ``en``, ``EN``, ``en-US`` and ``en_GB`` are one
  language; one that is no language tag is no evidence);
* the prior of its host, smoothed towards its site's and that towards the
  whole corpus's language mix, from grouped sums over all documents.

Every document is scored over its whole text (its mean trigram score, weighed
as ``text_weight`` trigrams at most, as neighbouring trigrams are not
independent).  The corpus passes work on one small row a document; texts are
never shuffled.  A hot host is summed map-side and its prior comes back
through a salted join.  The sample is the same in every run and for every
order of the table; every declared language has a model, 0.5 MB each on the
driver.

A document is rejected when its text has no letters, when the best posterior
is under ``min_posterior``, or when the best language is not among the
``accepted`` ones (default: all that the declarations name).

Defined results: a null or empty text has no language and is rejected; a null
declaration, address or host is no evidence (a null host shares one prior);
ties go to the language that comes first by name; repeated rows are judged
alike; with no declared document nothing can be learnt and all are rejected;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, salted_lookup, stored, table
from .textnum import LOWER, SPACE, Block, blocks, map_blocks

BUCKETS = 1 << 16
#: Distinct texts a language may have in the sample, however many languages share train_rows.
LEAST_ROWS = 100
_FOLD = np.where(SPACE, 0x20, LOWER).astype(np.uint8)
_LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])


def _trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every three bytes of the block's texts, folded."""
    b = _FOLD[block.bytes].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    doc = np.repeat(np.arange(block.n), np.diff(block.at))
    inside = doc[2:] == doc[:-2]  # the last byte of a text is the space after it
    return doc[:-2][inside], bucket[inside]


def primary_tag(declared: Column) -> Column:
    """The primary subtag of a language tag, A-Z lowered; null if it is none
    (2 to 8 letters or digits, up to the first ``-`` or ``_``)."""
    tag = F.regexp_extract(F.trim(declared), r"\A([A-Za-z0-9]{2,8})(?:[-_].*)?\z", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def sample(docs: DataFrame, train_rows: int) -> DataFrame:
    """declared, text: of every declared language its distinct texts of least
    hash.  ``docs``: text, declared."""
    rows = docs.where("declared IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    hashes = stored(rows.select("declared", "h").distinct())
    # a row a language, each of which also has a model on the driver
    texts = {r["declared"]: r["n"] for r in hashes.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(train_rows // max(len(texts), 1), LEAST_ROWS)
    # a threshold that about four times as many hashes pass comes first, so the
    # window of a language is as small however many texts and tasks there are
    share = (F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64
    many = F.create_map(*[F.lit(x) for kv in sorted(texts.items()) for x in kv]) if texts else F.lit(None).cast("map<string,bigint>")
    low = hashes.where(share * many[F.col("declared")] <= 4 * each)
    least = Window.partitionBy("declared").orderBy("h")
    picked = stored(low.withColumn("place", F.row_number().over(least)).where(F.col("place") <= each).select("declared", "h"))
    # copies collapse map-side (equal hashes are taken for equal texts)
    return (rows.join(picked, ["declared", "h"], "left_semi").groupBy("declared", "h")
            .agg(F.min("text").alias("text")).select("declared", "text"))


def learn(docs: DataFrame, train_rows: int = 4000, smooth: float = 0.5):
    """(languages, log P(bucket | language)) from the ``sample`` of ``docs``.
    ``docs``: text, declared."""
    part = sample(docs, train_rows).repartition("declared")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in blocks(batch):
                block, names = Block(rows.column("text")), rows.column("declared").to_pylist()
                doc, bucket = _trigrams(block)
                kinds = {k: i for i, k in enumerate(sorted(set(names)))}
                which = np.array([kinds[x] for x in names])[doc]
                for k, i in kinds.items():
                    got = np.bincount(bucket[which == i], minlength=BUCKETS)
                    sums[k] = sums[k] + got if k in sums else got
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"language": [k], "counts": [v.astype("<i4").tobytes()]})
    # a language is in one task: one row each
    rows = part.mapInArrow(count, "language string, counts binary").collect()
    tables = {r["language"]: np.frombuffer(r["counts"], "<i4") for r in rows}
    names = sorted(tables)
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts = np.stack([tables[k] for k in names]) + smooth
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def text_scores(docs: DataFrame, names: list[str], logs: np.ndarray, text_weight: int) -> DataFrame:
    """The columns of ``docs`` but text, plus scores array<double> (empty: no letters)."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", scores array<double>"

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(part.column("text"))
        doc, bucket = _trigrams(block)
        n = np.bincount(doc, minlength=block.n)
        letters = block.per_text(_LETTER[block.bytes]) > 0
        sums = np.stack([np.bincount(doc, weights=row[bucket], minlength=block.n) for row in logs])
        fused = (sums / np.maximum(n, 1) * np.minimum(n, text_weight)).T
        out = [list(map(float, fused[i])) if letters[i] else [] for i in range(block.n)]
        return pa.RecordBatch.from_arrays(
            [part.column(f.name) for f in others] + [pa.array(out, pa.list_(pa.float64()))],
            names=[f.name for f in others] + ["scores"])
    return map_blocks(docs, score, schema, size=1 << 20)


def _argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _logs(counts: list[Column], total: Column, prior: list[Column], weight: float) -> Column:
    """log((count + weight * prior) / (total + weight)) for each language."""
    return F.array(*[F.log((c + F.lit(weight) * p) / (total + F.lit(weight))) for c, p in zip(counts, prior)])


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
             address: str | None = None, keep: tuple[str, ...] = ("doc_id",), train_rows: int = 4000,
             text_weight: int = 60, min_posterior: float = 0.5, weight: float = 5.0,
             accepted: tuple[str, ...] | None = None, salts: int = 32) -> DataFrame:
    """The ``keep`` columns, language, posterior and kept, one row a document."""
    keys = {f"k{i}": c for i, c in enumerate(keep)}
    d = pick(docs, **keys, text=text, declared=declared, host=host, **({"address": address} if address else {}))
    where = F.coalesce(F.col("host"), F.lit(""))
    suffix = F.regexp_extract(F.coalesce(F.col("address") if address else F.lit(None).cast("string"), F.lit("")),
                              r"(?s)\A.*?://[^/?#]*\.([A-Za-z]+)(?:[:/?#]|\z)", 1)
    d = d.select(*keys, "text", F.coalesce(primary_tag(F.col("declared")), F.lit("")).alias("declared"), where.alias("host"),
                 F.regexp_extract(where, r"([^.]+\.[^.]+)\z|\A([^.]*)\z", 0).alias("site"),
                 F.lower(suffix).alias("suffix"))
    names, logs = learn(d.select("text", F.nullif("declared", F.lit("")).alias("declared")), train_rows)
    kept_names = [F.col(k).alias(c) for k, c in keys.items()]
    if not names:
        return d.select(*kept_names, F.lit(None).cast("string").alias("language"),
                        F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    scored = cut(text_scores(d, names, logs, text_weight)).withColumn("uid", F.monotonically_increasing_id())
    votes = scored.where("size(scores) > 0").withColumn("best", _argmax(F.col("scores")))
    L = range(len(names))

    def tallies(df, *by):
        return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("total"),
                                   *[F.count_if(F.col("best") == i).cast("double").alias(f"n{i}") for i in L])
    # one row: the corpus's language mix
    mix = tallies(votes).first()
    whole = [(mix[f"n{i}"] + 1) / (mix["total"] + len(names)) for i in L]

    def likelihood(column, out):
        """P(value | language) by value, over all documents that have a value."""
        have = votes.where(F.col(column) != "")
        t, kinds = tallies(have).first(), max(1, have.select(column).distinct().count())
        counts = [F.col(f"n{i}") for i in L]
        return tallies(have, column).select(column, F.array(*[
            F.log((c + 0.5) / F.lit(t[f"n{i}"] + 0.5 * kinds)) for i, c in zip(L, counts)]).alias(out))

    site = tallies(votes, "site").select("site", *[
        ((F.col(f"n{i}") + weight * whole[i]) / (F.col("total") + weight)).alias(f"s{i}") for i in L])
    prior = (tallies(votes, "host", "site").join(site, "site").select("host", _logs(
        [F.col(f"n{i}") for i in L], F.col("total"), [F.col(f"s{i}") for i in L], weight).alias("prior")))
    out = scored
    for dims, column in ((prior, "host"), (likelihood("declared", "by_declared"), "declared"),
                         (likelihood("suffix", "by_suffix"), "suffix")):
        out = salted_lookup(out, dims, column, "uid", salts)
    none = F.array(*[F.lit(0.0) for _ in L])
    base = F.array(*[F.lit(float(np.log(p))) for p in whole])
    added = [F.col("scores"), F.coalesce("prior", base), F.coalesce("by_declared", none), F.coalesce("by_suffix", none)]
    total = added[0]
    for more in added[1:]:
        total = F.zip_with(total, more, lambda a, b: a + b)
    out = out.withColumn("total", F.when(F.size("scores") > 0, total)).withColumn("top", F.array_max("total"))
    odds = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    out = out.withColumn("posterior", 1 / odds).withColumn(
        "language", F.get(F.array(*[F.lit(x) for x in names]), _argmax(F.col("total"))))
    ok = F.col("language").isin(list(accepted)) if accepted is not None else F.lit(True)
    return out.select(*kept_names, "language", "posterior",
                      F.coalesce((F.col("posterior") >= min_posterior) & ok, F.lit(False)).alias("kept"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
