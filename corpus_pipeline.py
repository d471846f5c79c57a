"""From raw documents to packed sequences, stage by stage.

language ID -> line dedup -> near duplicates -> secret scans -> packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of
``documents`` (the last one: the packed pieces).  Texts stay where they are:
a stage works out its decisions on small rows and joins only these back, by
doc_id and a hash of the whole row, so rows that are repeated are decided
alike and null ids are no exception.

Defined results beyond the operators' own: extra columns are dropped; an
empty table gives an empty table; documents without words are never near
duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfoil.llm import jaccard_join, language_id, line_dedup, packing, secret_scan
from counterfoil.llm.common import pick, stored, table
from counterfoil.llm.url_filter import Level

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: The most bits of the filter of ids to look up; beyond some 7 M ids it lets more rows through.
FILTER_BITS = 1 << 26


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``row_id`` (no id, id, hash of the row)."""
    d = pick(docs, **{c: c for c in COLUMNS})
    return d.withColumn("row_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id",
                                           F.xxhash64(*COLUMNS).alias("row_hash")))


def _same_row():
    return F.col("_rid").eqNullSafe(F.col("row_id"))


def _split(d: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``d`` that ``ids`` (_rid) certainly lacks, and the others:
    only these need a join with it, so the other texts are not shuffled."""
    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = Level(0, 1, 0.02)
    seen.m = min(FILTER_BITS, max(64, 9 * ids.count()))
    seen.build(ids.select(name("_rid.doc_id").alias("key")))
    maybe = seen.holds(name("doc_id"))
    return d.where(~maybe), d.where(maybe)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a clear language go."""
    d = _rows(docs)
    judged = language_id.identify(d, keep=("row_id",))
    out = stored(judged.where(~F.col("kept")).select(F.col("row_id").alias("_rid")).distinct())
    return d.join(out, _same_row(), "left_anti").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a site's boilerplate lines go, every document stays.  Copies
    of a text count once and no text goes whole, so the next stage finds them."""
    d = line_dedup.dedup_lines(docs, keep=("doc_id", "lang", "source"), distinct_texts=True)
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the least id stays."""
    d = _rows(docs)
    joined = jaccard_join.jaccard_join(d, NEAR_WORDS, NEAR_PERCENT, 100, doc_id="row_id").where("n_shingles > 0")
    per_row = joined.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("times"))
    # rows to drop (one = false), and rows that are repeated and stay once
    acts = stored(per_row.where("doc_id <> component_id OR times > 1").select(
        F.col("doc_id").alias("_rid"), (F.col("doc_id") == F.col("component_id")).alias("one")))
    drop, once = acts.where("NOT one").select("_rid"), acts.where("one").select("_rid")
    clear, d = _split(d, acts)
    if not once.limit(1).count():
        return clear.unionAll(d.join(drop, _same_row(), "left_anti")).select(*COLUMNS)
    single = d.join(acts.select("_rid"), _same_row(), "left_anti")
    repeated = d.join(once, _same_row(), "left_semi").dropDuplicates(["row_id"])
    return clear.unionAll(single).unionAll(repeated).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark; bare tokens that do not look live stay."""
    d = _rows(docs)
    found = secret_scan.scan_secrets(d.withColumn("doc_id", F.col("row_id")), must_look=True)
    spans = stored(found.withColumn("spans", F.concat("base", "added")).where("size(spans) > 0").select(
        F.col("doc_id").alias("_rid"), F.transform("spans", lambda s: s.dropFields("hash", "looks")).alias("spans"))
        .dropDuplicates(["_rid"]))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    return (d.join(spans, _same_row(), "left").withColumn("text", text)
            .select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: token pieces with their sequence and place."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", detect_language), ("line_dedup", dedup_lines),
          ("near_duplicates", drop_near_duplicates), ("secret_scans", redact_secrets),
          ("best_fit_packing", pack_sequences)]

#: Language scores, block hashes and tokenizer ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
