"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of tokens.  Every neighbouring pair that
can merge sits in the bucket of its merge rank; a three-level bitmap over the
ranks (a bit a bucket, a bit a word of buckets, a bit a word of words) finds
the lowest rank that has pairs by find-first-set, in constant time however
long the list is.  A bucket gives its leftmost place first; entries whose
place has since changed are stale and skipped.  A merge adds at most two new
pairs, so a pre-token of n bytes takes O(n log n) whatever its merges are.
Short pre-tokens share one queue: their lists lie end to end in arrays, and a
pop takes a rank's whole bucket, one place a pre-token.

Texts are cut into space-led words first: where every run of white space is a
single character, no match of the pattern crosses a space, so a word's ids
never depend on its neighbours and each distinct word of a task is encoded
once (a cache of bounded size).  Other texts go through the pattern whole.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table
from .textnum import map_blocks

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Places by merge rank; ``pop`` gives the leftmost place of the lowest rank."""

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.low: dict[int, int] = {}   # bits of ranks, 64 a word
        self.mid: dict[int, int] = {}   # bits of words
        self.top = 0                    # bits of mid words

    def _mark(self, rank: int) -> None:
        w, m = rank >> 6, rank >> 12
        self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
        self.mid[m] = self.mid.get(m, 0) | 1 << (w & 63)
        self.top |= 1 << m

    def _clear(self, rank: int) -> None:
        w, m = rank >> 6, rank >> 12
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[m] &= ~(1 << (w & 63))
            if not self.mid[m]:
                self.top &= ~(1 << m)

    def _first(self) -> int:
        m = (self.top & -self.top).bit_length() - 1
        bits = self.mid[m]
        w = m << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[w]
        return w << 6 | (bits & -bits).bit_length() - 1

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, place)
        else:
            self.buckets[rank] = [place]
            self._mark(rank)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        rank = self._first()
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            self._clear(rank)
        return rank, place


class PlaceQueue(RankQueue):
    """The same queue over arrays of places: ``pop`` gives the whole lowest bucket."""

    def put(self, rank: int, places: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(places)
            return
        self.buckets[rank] = [places]
        self._mark(rank)

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        have = ranks >= 0
        ranks, places = ranks[have], places[have]
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
        edges = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        for a, b, rank in zip(edges, edges[1:], ranks[edges[:-1]].tolist()):
            self.put(rank, places[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        rank = self._first()
        bucket = self.buckets.pop(rank)
        self._clear(rank)
        return rank, np.unique(np.concatenate(bucket)) if len(bucket) > 1 else np.sort(bucket[0])


class Codec:
    """Encodes and decodes by a table of ranks; what it makes is cached up to ``cache`` words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000, long_piece: int = 256):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in ranks.values()}
        self.singles = [ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pairs: dict[int, int] = {}  # left id, right id: the merged id
        for token, i in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = i
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ids = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.most, self.long_piece = cache, long_piece
        self.cached: dict[str, tuple[str, bytes, int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, place by place."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, pairs = len(piece), self.pairs
        ids = [self.singles[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if ids[i] < 0 or (j := after[i]) >= n or pairs.get(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: the place has merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(rank << 20 | ids[k])
                if new is not None:
                    queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = pairs.get(ids[h] << 20 | rank)
                if new is not None:
                    queue.push(new, h)
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pre-tokens through one queue: their lists lie end
        to end, and a step merges the leftmost place of the lowest rank in
        every pre-token that has one there."""
        lens = np.array([len(p) for p in pieces], np.int64)
        n = int(lens.sum())
        none = (1 << 19) + 1  # no id: pairs with it have no rank
        ids = np.full(n + 1, none, np.int64)
        ids[:n] = np.array(self.singles, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.append(np.repeat(np.arange(len(pieces)), lens), -1)
        ends = np.cumsum(lens)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - lens] = n
        pair = np.full(n + 1, -1, np.int64)  # rank of the pair that begins at a place
        queue = PlaceQueue()
        places = np.arange(n)
        while True:
            ranks = self._rank(ids[places], ids[after[places]])
            pair[places] = ranks
            queue.push(ranks, places)
            found = queue.pop()
            while found is not None:
                rank, at = found
                at = at[pair[at] == rank]  # the others are stale
                if len(at):
                    break
                found = queue.pop()
            if found is None:
                break
            if len(at) > 1:
                first = np.append(True, np.diff(word[at]) != 0)
                if not first.all():
                    queue.put(rank, at[~first])
                    at = at[first]
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone], pair[gone] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            left = before[at]
            # at most one place a pre-token, so left and at never meet
            places = np.concatenate([left[left < n], at])
        alive = ids[:n] >= 0
        out, counts = ids[:n][alive].tolist(), np.bincount(word[:n][alive], minlength=len(pieces))
        stops = np.cumsum(counts).tolist()
        return [out[a:b] for a, b in zip([0] + stops[:-1], stops)]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.merge(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """Parts of ``text`` that no match of the pattern crosses."""
        if " ".join(text.split()) != text.replace("\n", " "):
            return [text] if text else []  # white space in runs, at an end, or of another kind
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return words if text else []

    def learn(self, words: set[str]) -> dict[str, tuple[str, bytes, int]]:
        """(ids as text, decoded bytes, ids) of each word."""
        parts = {w: [p.encode() for p in self.find(w)] for w in words}
        known: dict[bytes, list[int]] = {}
        fresh = []
        for pieces in parts.values():
            for p in pieces:
                if p not in known:
                    whole = self.ranks.get(p)
                    known[p] = [whole] if whole is not None else []
                    if whole is None:
                        if len(p) > self.long_piece:
                            known[p] = self.merge(p)
                        else:
                            fresh.append(p)
        for p, ids in zip(fresh, self.merge_all(fresh) if fresh else []):
            known[p] = ids
        out = {}
        for w, pieces in parts.items():
            ids = known[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in known[p]]
            out[w] = (" ".join([self.text_of[i] for i in ids]), self.decode(ids), len(ids))
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids, sha256 of the ids joined by spaces, sha256 of the decoded bytes) of each text."""
        cached = self.cached
        if len(cached) > self.most:
            cached.clear()
        fresh: set[str] = set()
        for t in texts:
            fresh.update(self.words(t))
        fresh.difference_update(cached.keys())
        cached.update(self.learn(fresh))
        out = []
        for t in texts:
            ids, decoded, counts = zip(*map(cached.__getitem__, self.words(t))) if t else ((), (), ())
            out.append((sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(),
                        hashlib.sha256(b"".join(decoded)).hexdigest()))
        for w in fresh:
            if len(w) >= 64:
                del cached[w]
        return out


_codecs: dict[tuple, Codec] = {}  # of a Python worker, kept from task to task


def codec(path: str, pattern: str, cache: int = 400_000) -> Codec:
    key = (path, pattern, cache)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern, cache)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, cache: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    d = pick(docs, doc_id="doc_id", text="text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern, cache)
        n, ids, decoded = map(list, zip(*c.digests([t or "" for t in part.column("text").to_pylist()])))
        return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "n_tokens": n,
                                           "ids_sha256": ids, "decoded_sha256": decoded})
    return map_blocks(d, run, SCHEMA, size=24 << 20)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
