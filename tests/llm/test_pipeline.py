"""The pipeline against a brute-force version of its stages, and the registered queries."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from counterfoil.llm import line_dedup, registry

from .test_native import base_spans
from .texts import DOCS, corpus, frame, linked, shingle_set


def after_dedup(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.execute("SELECT doc_id, text, lang, source, length(text) FROM ("
                       + line_dedup.dedup_sql("documents") + ")").fetchall()


def least_of_groups(rows):
    sets = [shingle_set(r[1], 5) for r in rows]
    groups = defaultdict(list)
    for r, s, c in zip(rows, sets, linked(sets, 80, 100)):
        groups[c if s else (c, "alone")].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def redacted(rows):
    word = "[A-Za-z0-9+/_=-]"
    bare = re.compile(f"(?<!{word})(?={word}*[0-9])(?={word}*[A-Za-z]){word}{{20,}}")
    owners, repos, spans = defaultdict(set), defaultdict(set), []
    for r in rows:
        t, base = r[1] or "", base_spans(r[1])
        found = [(a, b, t[a:b]) for a, _, b in base]
        for m in re.finditer(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            found = [(a, b, m[1] if (a, b) == m.span() else v) for a, b, v in found]
        more = [(*m.span(), m[0]) for m in bare.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        for _, _, v in found + more:
            owners[v].add(r[3])
            repos[v].add((r[3], r[2]))
        spans.append((found, more))
    out = []
    for r, (found, more) in zip(rows, spans):
        live = [x for x in more if not (len(owners[x[2]]) >= 3 and len(repos[x[2]]) >= 3)]
        text, at = "", 0
        for a, b, _ in sorted(found + live, key=lambda x: x[:2]):
            if a >= at:
                text += r[1][at:a] + "[SECRET]"
            at = max(at, b)
        t = None if r[1] is None else text + r[1][at:]
        out.append((r[0], t, r[2], r[3], None if t is None else len(t)))
    return out


def pieces(rows, library=Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))):
    out = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            out[(r[0], i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    return out


def rows_of(df):
    return Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect())


def test_stages_match_brute_force(spark):
    rows = corpus(seed=4, families=12)
    named = dict(corpus_pipeline.STAGES)
    judged = named["language_id"](spark, frame(spark, rows), "")
    assert judged.columns == list(corpus_pipeline.COLUMNS)
    letters = Counter(r for r in rows if re.search("[A-Za-z\x80-\U0010ffff]", r[1] or ""))
    assert not rows_of(judged) - letters and rows_of(judged).total() >= 0.9 * letters.total()
    assert rows_of(named["line_dedup"](spark, frame(spark, rows), "")) == Counter(after_dedup(rows))
    near = rows_of(named["near_duplicates"](spark, frame(spark, rows), ""))
    assert near == Counter(least_of_groups(rows)) and near.total() < len(rows)
    assert rows_of(named["secret_scans"](spark, frame(spark, rows), "")) == Counter(redacted(rows))
    packed = named["best_fit_packing"](spark, frame(spark, rows), "").collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces(rows)


def test_copies_keep_one_text(spark):
    """Copies of a text are no boilerplate: one of them stays, whole; a site's line goes."""
    copied, near = "a first line of some words\nand a second line of it", "one line of words that many pages repeat"
    texts = [copied] * 4 + [near] * 3 + [near + "\n"] * 2 + [near + "\n\n"] + ["", None]
    texts += [f"Site line.\nown words of page number {i}" for i in range(8)]
    rows = [(i, t, "en", "s1", 0) for i, t in enumerate(texts)] + [(90, copied, "en", "s2", 0)]
    named = dict(corpus_pipeline.STAGES)
    lines = named["line_dedup"](spark, frame(spark, rows), "")
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(got[i] == copied for i in (0, 1, 2, 3, 90))
    assert all(got[i] == texts[i] for i in range(4, 12))
    assert all(got[i] == texts[i].split("\n")[1] for i in range(12, 20))
    left = Counter(r["text"] for r in named["near_duplicates"](spark, lines, "").collect())
    assert left[copied] == 1 and sum(n for t, n in left.items() if (t or "").strip() == near) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_pipeline_over_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    want = pieces(redacted(least_of_groups(after_dedup(docs))))  # every document has a clear language
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_every_query_is_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {re.match(r"op\d+_", n)[0] for n in registry.QUERIES} == {f"op{i}_" for i in range(1, 14)}
    assert set(registry.QUERIES) | {"pipeline"} <= set(names) and set(registry.SQL) <= set(registry.QUERIES)
