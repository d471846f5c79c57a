"""Top-k search, Jaccard join, HTML extraction, quality rules, language ID."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from counterfoil.llm import html_text, jaccard_join, language_id, quality_rules, textnum, topk_search
from counterfoil.llm.common import pick
from counterfoil.llm.textnum import Block

from .texts import DOCS, corpus, frame, linked, lowered, shingle_set, split_words, words


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_matches_brute_force(spark, width, num):
    rows = corpus(seed=width, families=14, copies=7)
    sets = [shingle_set(r[1], width) for r in rows]
    root = linked(sets, num, 100)
    least = defaultdict(list)
    for r, c in zip(rows, root):
        least[c].append(r[0])
    ids = {c: min((x for x in v if x is not None), default=None) for c, v in least.items()}
    # the corpus repeats one row, whose id is one id
    want = Counter((r[0], len(s), ids[c] if s else r[0]) for r, s, c in zip(rows, sets, root))
    got = jaccard_join.jaccard_join(frame(spark, rows), width, num, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_jaccard_join_splits_large_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_DOCS", 4)
    rnd = random.Random(5)
    base = words(rnd, 150)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 8])):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    sets = [shingle_set(r[1], 3) for r in rows]
    got = jaccard_join.jaccard_join(frame(spark, rows), 3, 90, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(linked(sets, 90, 100)))


@pytest.mark.parametrize("num", [60, 80, 90, 97])
def test_linked_sets_share_a_block(num):
    """Sets at the threshold, of every small size, share a block key."""
    import numpy as np
    rnd, bands = np.random.default_rng(2), jaccard_join.Bands(num, 100)
    for n in [*range(2, 60), 150, 400]:
        for _ in range(6):
            a = rnd.integers(0, 2 ** 63, n, dtype=np.uint64)
            gone = rnd.integers(0, n + 1)
            more = rnd.integers(0, n + 1)
            b = np.concatenate([a[gone:], rnd.integers(0, 2 ** 63, more, dtype=np.uint64)])
            both = n - gone
            if not len(b) or 100 * both < num * (n + len(b) - both) or (gone == 0 and more == 0):
                continue
            (x, nx), (y, ny) = (jaccard_join.block_keys(np.unique(s), bands) for s in (a, b))
            both = set(x.tolist()) & set(y.tolist())
            needs = [k for keys, need in ((x, nx), (y, ny)) for i, k in zip(keys.tolist(), need.tolist()) if i in both]
            assert both and len(both) >= min(needs), (n, gone, more)
            # no cut of either one has fewer of the shared keys than its need
            for keys, need in ((x, nx), (y, ny)):
                counts = Counter(i for k, i in zip(keys.tolist(), need.tolist()) if k in both)
                assert all(have >= i for i, have in counts.items()), (n, gone, more)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_DOCS", 16)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "DENSE", 3)
    monkeypatch.setattr(topk_search, "QUERY_TERMS", 300)
    rows = [r for r in corpus() if len(r[1] or "") < 5000]
    docs = frame(spark, rows)
    queries = pick(docs, query_id="doc_id", text="text", lang="lang").where("query_id % 5 = 0")
    got = defaultdict(list)
    for r in topk_search.search(docs, queries, k=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    bags = [Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered(r[1]))) for r in rows]
    df, n = Counter(t for b in bags for t in b), len(rows)
    mean = sum(sum(b.values()) for b in bags) / n
    for q, bag in zip(rows, bags):
        if q[0] is None or q[0] % 5:
            continue
        scores = []
        for r, b in zip(rows, bags):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2
                    / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in bag if t in b)
            if s > 0:
                scores.append((-round(s, 8), math.inf if r[0] is None else r[0]))
        best = sorted(scores)[:4]
        assert [x for x, _ in got[q[0]]] == [None if d == math.inf else d for _, d in best]
        assert all(abs(x + y[0]) < 1e-6 for (_, x), y in zip(got[q[0]], best))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><h2>Site</h2></header><div class="cookie-notice">Accept!</div>
%s<aside>See also</aside><form><label>Mail</label><input></form><div id="comments"><p>First comment by a reader, rather long.</p></div>
<footer>&copy; x</footer></body></html>"""
BODY = "<h1>Tom &amp; Jerry</h1><p>One  <b>two</b>\n three&nbsp;four.<p>Be.</p><!-- no --><div class='ad'>Buy</div><ul><li>item</li></ul>"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &lt;text&gt;", "plain <text>"),
    (PAGE % f"<article>{BODY}</article>", "Tom & Jerry\nOne two three four.\nBe.\nitem"),
    (PAGE % f"<main>{BODY}</main>", "Tom & Jerry\nOne two three four.\nBe.\nitem"),
    (PAGE % ("<div><h1>Head</h1><p>" + "word " * 40 + "</p><p>Be.</p></div>"), "Head\n" + ("word " * 40).strip() + "\nBe."),
    ("<article><p>unclosed <b>bold<br><p>next</article>", "unclosed bold\nnext"),
    ("<article>a < b &#x41;&eacute;</article>", "a < b Aé"),
    ("<script>never closed <p>x", ""), ("<div class='ad'>x", "")])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


MAIN = ("word and another of the main text. " * 8).strip()


@pytest.mark.parametrize("page,text", [
    (f"<html><head><title>T</title><meta><body><article><p>{MAIN}</article>", MAIN),
    (f"<html><head><title>T</title><link><article><p>{MAIN}</article>", MAIN),
    (f"<html><head><title>T<meta><body><article><p>{MAIN}</article>", MAIN),
    ("<head><title>T</title>plain text", "plain text"),
    (f"<div><select><option>a<option>b</div><svg><path d='x'/></svg><p>{MAIN}", MAIN),
    (f"<div><object><svg><path></div><div><template>t</div><p>{MAIN}", MAIN),
    (f"<form><div class=ad>Buy</div><nav>Home</nav><p>{MAIN}</form>", MAIN),
    (f"<form><article><p>{MAIN}</article></form>", MAIN),
    (f"<form><article><p>Be.</article><div class=comments><p>{MAIN}</div></form>", "Be."),
    (f"<form><p>{MAIN[:69]}</p></form><p>{MAIN}", MAIN),
    *[(f"<div class='{c}'><p>{MAIN}</div><div class='sidebar'>Other</div>", MAIN)
      for c in ("content with-sidebar", "has-sidebar", "no-comments", "page sidebar-right")],
    (f"<article><p>{MAIN}</article><div class=comments><p>{MAIN} {MAIN}</div>", MAIN),
    (f"<article>Card one</article><article><a href=x>Card</a></article><div>Top</div><nav>x</nav><div><p>{MAIN}</div>",
     f"Top\n{MAIN}")])
def test_main_text_of_loose_markup(page, text):
    assert html_text.main_text(page) == text


COOKIE = "We use cookies and other means to tell visitors apart; by reading on you agree to all of them, and to our terms of use."
PARAGRAPHS = [("word and another of the main text. " * k).strip() for k in (9, 3, 12, 1, 7)]
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5)) + "</ul>"


def unmarked(body, before="", after=""):
    return f"<html><head><title>T</title></head><body>{before}<div>{body}</div>{after}</body></html>"


@pytest.mark.parametrize("before,after", [
    ("<div>Contact</div>", "<div>Copyright 2020 Example Ltd</div><div>Terms</div>"),
    (f"<div>{MENU}</div><div>Contact</div><div>{COOKIE}</div>", f"<div>{MENU}</div><div>All rights reserved</div>"),
    (f"<div>{COOKIE}</div>", f"<div><p>Great post, thanks!</p></div><div>{MENU}</div>"),
    ("<table><tr><td>Home<td>Shop</table>", "<div><div>Read next</div><div><a href=x>A long title of another page of this very site</a></div></div>")])
def test_unmarked_pages_keep_the_main_text_only(before, after):
    body = "<h1>The title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "<p>The end.</p>"
    want = "\n".join(["The title", *PARAGRAPHS, "The end."])
    assert html_text.main_text(unmarked(body, before, after)) == want
    # the same with every paragraph in a box of its own, but for what only its box tells
    parts = "<h1>The title</h1>" + "".join(f"<div>{p}</div>" for p in PARAGRAPHS)
    assert html_text.main_text(unmarked(parts, before, after)).split("\n")[-6:-1] == ["The title", *PARAGRAPHS[:4]]


def test_given_pages_without_their_marks():
    """The test data's pages: with marks as before; without article marks, classes and ids the menus, adverts
    and footers still go, but on pages whose text is no longer than they are."""
    import pyarrow.parquet as pq
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    same = clean = 0
    for page in pages:
        marked = html_text.main_text(page)
        plain = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b[^>]*>", r"<\1div>", page)
        plain = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", plain)
        got = html_text.main_text(plain)
        want, have = set(marked.split("\n")), set(got.split("\n"))
        same += len(want & have) >= 0.8 * len(want) and len(have - want) <= 1
        clean += "\u00a9" not in got
    assert same >= 0.95 * len(pages) and clean >= 0.95 * len(pages)


def test_unclosed_elements_take_linear_time():
    page = "".join(f"<{n}>" * 20_000 for n in ("object", "select", "svg", "textarea", "iframe"))
    assert html_text.main_text(page + "x") == ""


def test_extract_pages(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (None, None, None, "y"),
            (2, "v", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "z")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert Counter(r["page_id"] for r in got) == {1: 2, None: 1, 2: 1}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[2] == "\n".join(["long text"] * 20_000)


def measures(text):
    w, t = split_words(text), text or ""
    lines = [x for x in t.split("\n") if split_words(x)]
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    kept = not failed and not (
        2 * sum(map(len, w)) < 5 * len(w) or sum(map(len, w)) > 13 * len(w)
        or 10 * sum(t.count(c) for c in "#*$%&|<>") > len(w) or 5 * (len(lines) - len(set(lines))) > 2 * len(lines)
        or 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * len(w)
        or 100 * sum(any(ord(c) >= 0x80 or c.isalpha() for c in x) for x in w) < 55 * len(w))
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            failed, kept)


def test_quality_rules_match_brute_force(spark):
    rows = corpus(families=10) + [
        (200 + i, t, "en", "s", 1) for i, t in enumerate([
            "The The The The This This This This of of of of and and and and a b c d e f",
            "w1### w2%%% w3*** w4$$$ w5&&& w6||| w7 w8 w9 w10 w11 w12 w13", "1 2 3 4 5 6 7 8 9 10 11 12 13 word",
            "line one here\n" * 4 + "line two there now and then\nline three was also seen", "abcdefghijklmnopqrstuvwxyz" * 3 + " q" * 3])]
    got = quality_rules.judge_quality(frame(spark, rows), sample_rows=20).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *measures(r[1])) for r in rows)
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)


def lang_rows(n=400):
    rnd = random.Random(9)
    stems = {"en": ["the", "and", "ing", "thing", "with"], "fr": ["les", "eau", "ment", "dans", "été"],
             "de": ["der", "und", "schön", "ung", "nicht"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(stems))
        text = " ".join(rnd.choice(stems[lang]) + rnd.choice(["", "a", "o"]) for _ in range(rnd.randrange(5, 60)))
        told = lang if rnd.random() < 0.95 else "fr"
        rows.append((i, text, told, "one" if rnd.random() < 0.4 else f"www.{lang}.net", 1, lang))
    return rows


def test_language_id_held_out(spark):
    rows = lang_rows()
    got = language_id.identify(frame(spark, [r[:5] for r in rows]), train_rows=100).collect()
    right = {r[0]: r[5] for r in rows}
    assert sum(r["language"] == right[r["doc_id"]] for r in got) >= 0.98 * len(rows)
    assert sum(r["kept"] for r in got) >= 0.99 * len(rows)


def test_language_id_evidence_decides_without_text(spark):
    """A text between languages goes to its host's language and declaration."""
    rows = lang_rows(300) + [(900 + i, "a", "de", "www.de.net", 1, "") for i in range(2)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, [r[:5] for r in rows])).collect()}
    assert got[900]["language"] == got[901]["language"] == "de"


def test_language_id_learns_every_declared_language(spark):
    """Languages at the end of the table, rare ones, more than 64 of them, and one with many copies of a text."""
    rnd = random.Random(3)

    def rows(lang, at, n, copies=0):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)
        texts = [" ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(30)) for _ in range(n)]
        return [(at + i, t, lang, "s", 1) for i, t in enumerate(texts + texts[:1] * copies)]
    table = [r for i in range(70) for r in rows(f"l{i:02d}", 1000 * i, 40 if i < 60 else 12, 300 if i == 0 else 0)]
    first = spark.createDataFrame(table, DOCS)
    got = language_id.identify(first.coalesce(1), train_rows=400).collect()
    want = {r[0]: r[2] for r in table}
    assert {r["language"] for r in got} == set(want.values())
    assert sum(r["language"] == want[r["doc_id"]] for r in got) >= 0.97 * len(table)


def test_language_id_sample_does_not_depend_on_order(spark):
    rows = [r[:5] for r in lang_rows(900)]
    last = [(5000 + i, f"zq{i} zqx qzz zzq{i}", "zz", "s", 1) for i in range(300)]
    kept = []
    for table in (rows + last, (last + rows)[::-1]):
        docs = pick(spark.createDataFrame(table, DOCS).repartition(5), text="text", declared="lang")
        names, logs = language_id.learn(docs, 300)
        assert names == ["de", "en", "fr", "zz"]
        kept.append((Counter(map(tuple, language_id.sample(docs, 300).collect())), logs.tobytes()))
    assert kept[0] == kept[1] and set(Counter(k[0] for k in kept[0][0]).values()) == {100}


def test_language_id_suffix_and_site_decide(spark):
    """Texts without a trigram go to their address suffix's language, or to their site's."""
    rows = [(*r[:3], f"h{r[0] % 5}.{r[5]}.net", f"https://h.{r[5]}/p?x=1") for r in lang_rows(300)]
    rows += [(900, "a", None, None, "http://x.fr/p"), (901, "a", None, None, "http://x.EN:80"),
             (902, "a", None, "new.fr.net", None), (903, "a", None, "new-fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    with_url = {r["doc_id"]: r["language"] for r in language_id.identify(docs, address="url").collect()}
    assert [with_url[i] for i in (900, 901, 902)] == ["fr", "en", "fr"] and with_url[903] != "fr"
    without = {r["doc_id"]: r["language"] for r in language_id.identify(docs).collect()}
    assert without[900] == without[901] and without[902] == "fr"


def test_language_tags_of_one_language_are_one(spark):
    rnd = random.Random(2)
    rows = [r[:5] for r in lang_rows(400)]
    tags = ["en", "EN", "en-US", "en-us", "en_GB"]
    rows = [(i, t, rnd.choice(tags) if lang == "en" else lang, h, n) for i, t, lang, h, n in rows]
    rows += [(1000, rows[0][1], "not a language tag", None, 1)]
    got = language_id.identify(frame(spark, rows)).collect()
    assert {r["language"] for r in got} == {"en", "fr", "de"}
    tagged = spark.createDataFrame([(t,) for t in [*tags, None, "", "x", "zh-Hant-TW", " fr ", "a b", "sr_Latn"]], "t string")
    assert [r[0] for r in tagged.select(language_id.primary_tag(tagged.t)).collect()] == ["en"] * 5 + [None, None, None, "zh", "fr", None, "sr"]


def test_language_id_odd_rows(spark):
    rows = [r[:5] for r in lang_rows(100)] + [(500 + i, *r[1:]) for i, r in enumerate(corpus())]
    got = language_id.identify(frame(spark, rows), accepted=("en", "fr", "de")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        if not re.search("[A-Za-z\x80-\U0010ffff]", r[1] or ""):
            assert not by_id[r[0]]["kept"] and by_id[r[0]]["language"] is None
    none = frame(spark, [(1, "text", None, "s", 1), (2, None, None, None, 1)])
    assert [r["kept"] for r in language_id.identify(none).collect()] == [False, False]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert topk_search.search(empty, pick(empty, query_id="doc_id", text="text")).count() == 0
    assert quality_rules.judge_quality(empty).count() == 0
    assert language_id.identify(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(pages).count() == 0


def test_word_hashes_follow_the_words():
    texts = ["a b a", None, "", "\tTab a\n", "long" * 3000 + " b"]
    block = Block(pa.array(texts))
    seen = {}
    want = [w for t in texts for w in split_words(t)]
    for h, w in zip(block.word_hashes().tolist(), want, strict=True):
        assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(want))


def test_sets_are_read_in_the_batch_and_texts_in_small_parts():
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(n) for n in (3, 0, 1, 5)]
    tokens = pa.array([s.tobytes() for s in sets], pa.binary())
    views = jaccard_join._views(tokens)
    assert [v.tolist() for v in views] == [s.tolist() for s in sets]
    assert [v.tolist() for v in jaccard_join._views(tokens.slice(2))] == [s.tolist() for s in sets[2:]]
    assert not any(v.flags.owndata for v in views if len(v)) and jaccard_join._views(tokens[:0]) == []

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 1 << 40, 400)) for _ in range(2500)]
    out = list(jaccard_join.block_rows(Docs(), 5, 80, 100, 3)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    sent = [sum(len(k) for k in b.column("keys").to_pylist()) // 8 for b in out]
    assert len(sent) > 1 and max(sent) < 1 << 19  # no more than the most to send, and a part's keys


def test_little_stays_in_a_worker_after_long_texts():
    texts = pa.array(["word " * 20, "some words " * 300_000])
    short, long = Block(texts[:1]).word_hashes(), Block(texts).word_hashes()
    assert long[:20].tolist() == short.tolist() and len(set(long[20:].tolist())) == 2
    assert sum(p.nbytes for p in textnum._powers.values()) < 10 << 20


def test_block_keys_are_read_in_the_batch():
    class Rows:
        def __getattr__(self, name):
            return lambda run, *rest: run if name == "mapInArrow" else self
    rnd = np.random.default_rng(3)
    keys, n = rnd.integers(0, 1 << 62, 1 << 17).astype(np.uint64), 32
    rows = {"keys": pa.array([keys.tobytes()] * n, pa.binary()),
            "owners": pa.array([np.array([i % 2], np.int64).tobytes() for i in range(n)], pa.binary()),
            "runs": pa.array([np.array([len(keys)], np.uint32).tobytes()] * n, pa.binary()),
            "needs": pa.array([np.array([1], np.uint16).tobytes()] * n, pa.binary()),
            "bucket": pa.array(range(n), pa.int32())}
    # what a task holds beside the batch is a bucket, not the batch again
    run = jaccard_join.shared_blocks(Rows(), 1)
    tracemalloc.start()
    assert not list(run(iter([pa.RecordBatch.from_pydict(rows)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < keys.nbytes * n / 2  # the batch's keys are 32 MB
    rows["bucket"] = pa.array([0] * 2 + [1] * (n - 2), pa.int32())
    out = next(run(iter([pa.RecordBatch.from_pydict(rows).slice(0, 2)])))
    assert sorted(zip(out["key"].to_pylist(), out["h1"].to_pylist())) == sorted(
        (int(k), h) for k in set(keys.tolist()) for h in (0, 1))
