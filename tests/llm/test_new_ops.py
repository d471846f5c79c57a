"""Suffix-sort dedup, conversation prefix trie and hard negatives against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from counterfoil.llm import hard_negatives, prefix_trie, suffix_dedup

from .texts import corpus, frame


# -- suffix-sort dedup --------------------------------------------------------------------------------

def repeats_removed(rows, width):
    """{(doc_id, text): (kept bytes, removed spans)} by looking up every window."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - width + 1 if i is not None else 0):
            w = b[p:p + width]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1 if i is not None else 0):
            if least[b[p:p + width]] < i:
                gone[p:p + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        out[i, b] = (bytes(x for x, g in zip(b, gone) if not g), list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def found_repeats(df, width, hot=suffix_dedup.HOT):
    return [(r.doc_id, r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.removed])
            for r in suffix_dedup.drop_repeats(df, width, hot).collect()]


@pytest.mark.parametrize("width, hot", [(50, 8192), (50, 3), (9, 8192)])
def test_repeats_match_brute_force(spark, width, hot):
    rows = [r for r in corpus(seed=4) if width == 50 or len(r[1] or "") < 2000]
    want = repeats_removed([(r[0], r[1]) for r in rows], width)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    got = found_repeats(frame(spark, rows), width, hot)
    assert len(got) == len(rows)
    assert sum(bool(spans) for *_, spans in got) > 10
    left = sorted(((i, *want[i, b]) for i in texts for b in texts[i]), key=str)
    assert sorted(((i, kept, spans) for i, _, kept, spans in got), key=str) == left


def test_a_passage_in_every_document_stays_in_the_first_only(spark):
    passage = "this passage of more than fifty bytes stands in every one of them. " * 3
    rows = [(i, f"{i} start {i * 7} " + passage + f" end {i}", None, None, 0) for i in range(40)]
    got = {i: (n, spans) for i, n, _, spans in found_repeats(frame(spark, rows), 50, 10)}
    assert got[0][1] == [] and all(len(got[i][1]) == 1 for i in range(1, 40))


def test_a_text_that_repeats_itself_is_cut_and_sent_by_its_distances(spark):
    rows = [(i, "x" * i + " Is onhe." * (30 + 5 * i) + f"{i} and " + "ab" * 40 + " end" * (i % 3), None, None, 0) for i in range(24)]
    want = repeats_removed([(r[0], r[1]) for r in rows], 50)
    got = found_repeats(frame(spark, rows), 50, 20)  # fewer than 30 runs, but hundreds of their usual lengths
    assert sorted((i, kept, spans) for i, _, kept, spans in got) == sorted((i, *v) for (i, _), v in want.items())
    text = np.frombuffer(b". Is onhe" * 300, np.uint8)
    block = suffix_dedup.Texts({"block": 0, "data": suffix_dedup._zip(text.tobytes()), "bytes": len(text), "ids": np.array([7]).tobytes(),
                                "known": b"\1", "ends": np.array([len(text)]).tobytes()})
    keys, times = block.weighed(50)
    assert len(keys) == 1 and times[0] == -(-(2700 - 49) // 35)
    key, size, _, content, *_, repeated = suffix_dedup._contents(block, [{"shared": b"", "hot": keys.tobytes()}], 50)
    assert len(key) == 9 and size.tolist() == [50] * 9 and len(content) == 9 and repeated.sum() == 2651


def test_repeats_of_empty_table(spark):
    assert found_repeats(frame(spark, []), 50) == []


def test_suffix_sort_survives_hash_collisions():
    rnd = random.Random(3)
    data = np.frombuffer(bytes(rnd.choice(b"ab\x00") for _ in range(3000)), np.uint8)
    at, group = np.arange(2900), np.repeat([0, 1], [1000, 1900])

    class Colliding(suffix_dedup.SuffixSort):
        def _hash(self, at, size):
            return super()._hash(at, size) & np.uint64(3)
    for kind in (suffix_dedup.SuffixSort, Colliding):
        order, same = kind(data, 13).order(at, group)
        keys = [(group[i], data[at[i]:at[i] + 13].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(2900))
        assert same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_windows_of_equal_bytes_are_not_compared():
    """Copies, and windows that differ in their first bytes, meet no comparison of the mergesort."""
    rnd = random.Random(5)
    text = "".join(f"{rnd.random():.9f}"[2:] for _ in range(300))
    data = np.frombuffer((text * 3).encode(), np.uint8)
    at = np.arange(len(data) - 50)
    compared = []

    class Counting(suffix_dedup.SuffixSort):
        def less(self, a, b):
            compared.append(len(a))
            return super().less(a, b)
    order, same = Counting(data, 50).order(at, np.zeros(len(at), np.int64))
    keys = [data[i:i + 50].tobytes() for i in order]
    assert keys == sorted(keys) and same.sum() == len(at) - len(set(keys))
    assert sum(compared) < len(at)


def test_common_extension_by_prefix_hashes():
    data = np.frombuffer(b"abcabcabd" * 9, np.uint8)
    sort = suffix_dedup.SuffixSort(data, 20)
    a, b = np.array([0, 0, 3, 9]), np.array([3, 9, 6, 27])
    assert sort.common(a, b).tolist() == [5, 20, 2, 20]


# -- conversation prefix trie -------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, place long, key string, n long, level int"


def trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs),
                    sum(len(y) == len(node) + 1 and y[:-1] == node for y in members), len(childless),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rnd = random.Random(8)
    rows = []
    for c in list(range(0, 40)) + [100, 101, 150, 230, 231, 232, -5, -100, -103, 5000000]:
        same = rnd.random() < 0.4
        for t in range(3 if same else rnd.choice([1, 1, 2, 4, 7, 9, 20])):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rnd.choice(["user", "user", None]) if not same else "user",
                         f"turn {t}" if same or rnd.random() < 0.6 else rnd.choice([None, "", "🙂é", f"own {c} {t}"])))
    rows += [(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, None, "a"), (7, 1, "user", "a"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"long {t}") for c in (301, 302) for t in range(40 + c % 2)]
    return rows


def test_prefix_trie_matches_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 5, "k", -1, 3) for r in rows], CONVERSATIONS).repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.ranked_turns(df)))
    got = got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_prefix_trie_of_empty_table(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.ranked_turns(df))).collect() == []


def test_ids_of_a_crowded_node_are_hashed_in_order(spark):
    """Ids of many pieces end in one node."""
    ids = [i * 977 for i in range(60)]
    rows = [(c, t, "user", f"t{t}") for c in ids for t in range(2)]
    df = spark.createDataFrame([(*r, 5, "k", -1, 3) for r in rows], CONVERSATIONS)
    turns = prefix_trie.ranked_turns(df)
    got = {(r.depth, r.n_convs): r.ends_sha256 for r in prefix_trie.prefix_trie(turns).collect()}
    assert got[2, 60] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# -- hard negatives -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, uid long, q string, shard int, rank int"


def mined(rows):
    v = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (a, label, q) in enumerate(v):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), i, other == label)
                        for m, (i, other, r) in enumerate(v) if m != n)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors():
    rnd = random.Random(5)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c + rnd.gauss(0, 0.7) for c in rnd.choice(centre)], rnd.randrange(4)) for i in range(500)]
    hot = [0.5, -1.0, 2.0, 0.25, 0.0, 1.5]
    rows += [(1000 + i, hot, i % 4) for i in range(150)]
    rows += [(2000, hot, 1), (2000, hot, 1), (2000, hot, 2), (2100, [0.0] * 6, 1), (2200, [], 1), (2300, [3.0, 1.0], 2)]
    rows += [(None, hot, 1), (2400, None, 1), (2500, hot, None), (2600, [1.0, None], 1), (2700, [float("nan")] * 6, 1),
             (2800, [float("inf")] * 6, 1), (-100, [-c for c in hot], -3), (-7, hot, -1)]
    return rows


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = vectors()
    df = spark.createDataFrame([(*r, 5, "q", 1, 2) for r in rows], VECTORS).repartition(3)
    d = hard_negatives.whole_vectors(df)
    label = prefix_trie.F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    d = d.withColumn("label", label)
    got = hard_negatives.mine(d, d.where("vec_id % 100 = 0"))
    got = sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == mined(rows) and len(got) > 200


def test_hard_negatives_of_empty_table(spark):
    d = hard_negatives.whole_vectors(spark.createDataFrame([], VECTORS))
    assert hard_negatives.mine(d, d).collect() == []


def _lists(q, labels):
    q = np.array(q, np.int64)
    ids = np.arange(len(q), dtype=np.int64)
    return hard_negatives.Lists({"uids": ids.tobytes(), "ids": ids.tobytes(), "labels": np.array(labels, np.int64).tobytes(), "dims": q.shape[1],
                                 "values": q.tobytes(), "lists": np.argsort(q, axis=0, kind="stable").T.astype(np.int32).tobytes()})


def test_threshold_stops_early_and_exactly():
    rng = np.random.default_rng(1)
    q = np.rint(rng.normal(0, 10, (3000, 3))).astype(np.int64)
    q[:20] *= 20
    lists = _lists(q, np.zeros(3000))
    everyone = np.ones(3000, bool)
    for a in ([5, -3, 2], [0, 0, 4], [-1, -1, -1]):
        rows, score = lists.search(np.array(a), [(everyone, 7, None, None)])
        full = q @ np.array(a)
        assert rows.tolist() == sorted(range(3000), key=lambda i: (-full[i], i))[:7]
        assert lists.met < 1500


def test_scores_beyond_doubles_are_exact():
    big = 1 << 30
    lists = _lists([[big, 1], [big, 0], [big, 2]], [0, 0, 0])
    rows, score = lists.search(np.array([big, 1]), [(np.ones(3, bool), 3, None, None)])
    assert rows.tolist() == [2, 0, 1] and score[2] == big * big + 2


# -- word hash ----------------------------------------------------------------------------------------

def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_of_equal_polynomials_differ():
    import pyarrow as pa
    from counterfoil.llm.textnum import Block
    for bits in (4, 5, 6, 10, 11, 13):
        one, other = thue_morse(bits)
        h = Block(pa.array([one, other, one + " " + other])).word_hashes()
        assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_long_words_of_equal_polynomials_do_not_link(spark):
    from counterfoil.llm.jaccard_join import jaccard_join
    one, other = thue_morse(11)
    rows = [(1, one + " same same", "en", "s", 0), (2, other + " same same", "en", "s", 0), (3, one + " same same", "en", "s", 0)]
    got = {r.doc_id: r.component_id for r in jaccard_join(frame(spark, rows), 3, 90, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


# -- ties of the top-k search -------------------------------------------------------------------------

def one_term_shard(ids, counts, length):
    from counterfoil.llm.topk_search import Shard
    n = len(ids)
    return Shard({"ids": ids, "lengths": np.full(n, length, np.int32).tobytes(), "terms": np.array([5], np.int64).tobytes(),
                  "starts": np.array([0, n], np.int32).tobytes(), "docs": np.arange(n, dtype=np.uint16).tobytes(),
                  "counts": np.array(counts, np.uint16).tobytes()}, 100.0)


@pytest.mark.parametrize("parts", [1, 2])
def test_equal_small_scores_go_to_the_smaller_id(parts):
    from counterfoil.llm.topk_search import Search
    rnd = random.Random(parts)
    for trial in range(200):
        n = rnd.choice([20, 200, 300])     # few documents are summed posting by posting, many densely
        ids = rnd.sample(range(10 * n), n)
        counts = [rnd.choice([1, 1, 1, 2]) for _ in ids]
        search = Search([0, 1], [np.array([5]), np.array([5])], [np.array([rnd.uniform(1e-8, 0.3)]), np.array([rnd.uniform(0, 9)])], 10, 100.0)
        cut = [0, *sorted(rnd.sample(range(1, n), parts - 1)), n]
        for a, b in zip(cut, cut[1:]):
            search.shard(one_term_shard(ids[a:b], counts[a:b], 80))
        want = [i for _, i in sorted((-c, i) for c, i in zip(counts, ids))[:10]]
        for best in search.best:
            assert [i for _, i in sorted(best)] == want
