"""Byte-level BPE against the tiktoken library; word BPE against tokenizers; packing."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from counterfoil.llm import byte_bpe, packing

from .texts import DOCS, ODD, corpus, frame

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODEC = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, long_piece=40)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = public_tokenizers.path("word_bpe_49k.json")


def digest(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n\t's1.é漢\u2028\x1c", max_size=60), max_size=4))
def test_codec_matches_library(texts):
    assert CODEC.digests(texts) == [digest(t) for t in texts]
    for t in texts:
        assert CODEC.encode(t) == LIBRARY.encode_ordinary(t)
        assert CODEC.decode(CODEC.encode(t)) == t.encode()


def test_long_pretokens():
    rnd = random.Random(3)
    for t in ["a" * 20_000, "abc" * 9_000, "".join(rnd.choice("etaoin") for _ in range(50_000))]:
        assert CODEC.encode(t) == LIBRARY.encode_ordinary(t)
        assert CODEC.merge_all([t.encode()[:3000]]) == [CODEC.merge(t.encode()[:3000])]


def test_encode_documents(spark):
    rows = corpus()
    got = byte_bpe.encode_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                    public_tokenizers.PATTERN, cache=50).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *digest(r[1])) for r in rows)


def test_every_token_merges_into_its_two_parts():
    """The condition under which merging by joined bytes gives the file's merges."""
    import json
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    end = spec["model"]["end_of_word_suffix"]
    t = packing.WordTokenizer(WORDS)
    for merge in spec["model"]["merges"]:
        a, b = [packing.WordTokenizer.token_bytes(x, end) for x in (merge.split(" ") if isinstance(merge, str) else merge)]
        rank = t.ranks[a + b]
        parts = [bytes([x]) for x in a + b]
        while True:  # merges of lower rank only
            found = [(r, i) for i in range(len(parts) - 1)
                     if (r := t.ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]


TOKENIZER, WORD_LIBRARY = packing.WordTokenizer(WORDS, cache=100), Tokenizer.from_file(WORDS)


def library_ids(text):
    return WORD_LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="aB c\n'sé1.<|İΣ", max_size=60), max_size=4))
def test_word_tokenizer_matches_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [struct.pack(f"<{len(i)}I", *i) for i in map(library_ids, texts)]
    assert TOKENIZER.encode_all(texts) == want


def test_odd_texts_match_library():
    t = packing.WordTokenizer(WORDS)
    texts = [x or "" for x in ODD]
    assert [struct.unpack(f"<{len(x) // 4}I", x) for x in t.encode_all(texts)] == [tuple(library_ids(x)) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(
    st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=25))))
def test_plan_uses_every_piece_once(case):
    capacity, counts = case
    shapes = packing.plan(counts, capacity)
    assert all(0 < sum(s) <= capacity and n > 0 for s, n in shapes)
    used = Counter()
    for s, n in shapes:
        for x in s:
            used[x] += n
    assert used == Counter(counts)


def least_bins(sizes, capacity):
    """Fewest bins, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                j = rooms.index(r)
                go(i + 1, rooms[:j] + [r - sizes[i]] + rooms[j + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fixed_sets_keep_the_optimum(sizes):
    fixed, left = packing.fix_dominating(Counter(sizes), 20)
    rest = [s for s, c in left.items() for _ in range(c)]
    assert sum(n for _, n in fixed) + least_bins(rest, 20) == least_bins(sizes, 20)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_documents(spark, capacity):
    rows = corpus()
    got = packing.pack_documents(frame(spark, rows), WORDS, capacity, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = library_ids(r[1]) + [1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            raw = struct.pack(f"<{len(part)}I", *part)
            want[(r[0], i, at, len(part), zlib.crc32(raw), raw)] += 1
    assert Counter((*tuple(r)[:5], bytes(r["ids"])) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) <= capacity


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert byte_bpe.encode_documents(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.PATTERN).count() == 0


def test_a_task_tokenizes_small_parts(monkeypatch):
    class Docs:
        columns = ["doc_id", "text"]

        def mapInArrow(self, run, schema):
            return run
    parts, encode_all = [], packing.WordTokenizer.encode_all

    def seen(self, texts):
        parts.append(sum(map(len, texts)))
        return encode_all(self, texts)
    monkeypatch.setattr(packing, "pick", lambda docs, **_: docs)
    monkeypatch.setattr(packing.WordTokenizer, "encode_all", seen)
    texts = ["some words of a text " * 500] * 300
    run = packing.tokenize(Docs(), WORDS)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    ends = sum(b.column("length").to_numpy().sum() for b in run(iter([batch])))
    assert ends == 300 * (len(Tokenizer.from_file(WORDS).encode(texts[0], add_special_tokens=False).ids) + 1)
    assert max(parts) <= 1 << 20 and sum(parts) == sum(map(len, texts))


def test_a_full_cache_keeps_the_words_in_use():
    few = packing.WordTokenizer(WORDS, cache=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) + " the words, Of every text" for i in range(5)]
    library = Tokenizer.from_file(WORDS)
    for t in texts:
        got = few.encode_all([t])[0]
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t, add_special_tokens=False).ids
        assert len(few.cached) <= 50 + 66
    learned = []
    few._learn, learn = lambda words: (learned.extend(words), learn(words)), few._learn
    few.encode_all(["the words, Of other"])
    assert learned == ["other"]
