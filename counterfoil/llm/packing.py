"""Best-fit packing with Martello-Toth dominance reduction.

Every document is tokenized whole, ends with an end id, and is cut into
pieces only where it is longer than a sequence.  Packing depends on lengths
alone, so the instance is the histogram of piece lengths: at most
``capacity`` rows however large the corpus is.  On it, the driver

1. fixes sets that provably dominate every alternative: a length that nothing
   fits beside; a pair that fills a sequence exactly; a pair where no second
   piece fits; a pair whose partner is at least as long as the best two pieces
   that would fit instead;
2. packs what is left best-fit in decreasing order, all bins of one shape at
   a time.

Each step uses up a length or a bin shape, so the plan has a few shapes a
length at most.  Spark numbers the pieces of each length (by partition, then
within it) and looks each number up in the plan: no piece but its length ever
reaches the driver, and a hot length is numbered partition by partition.

Defined results: a null or empty text is the end id alone; pieces of equal
length are interchangeable and dealt by partition, doc_id, piece and content;
repeated rows are packed as documents of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table
from .textnum import map_blocks

CAPACITY = 4096
#: Bytes of text that a task tokenizes at a time.
TEXT_BYTES = 1 << 20
END_ID = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """Ids of the ``tokenizers`` library for a BPE file with word ends.

    White space only separates words there, so a text's ids are its words'
    ids in order, and each distinct word is encoded once (a bounded cache).
    Words of plain letters are merged by ``tiktoken`` over the same merges: a
    word end is written as the byte 0xFF, which UTF-8 never has.  That gives
    the same ids when every token's own bytes merge into the file's two parts
    of it (``tests/llm/test_bpe.py`` checks all of them).  Other words go
    through the library itself.
    """

    _PLAIN = re.compile("[!-~¡-įı-ɏ]+")

    def __init__(self, path: str, cache: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = {b: i for s, i in spec["model"]["vocab"].items() if s not in self.special
                      for b in [self.token_bytes(s, spec["model"]["end_of_word_suffix"])]}
        # the file's own pattern, as the library applies it to lowered text
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(f"{pattern}| ").findall
        self.merge = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.most, self.cached, self.pieces = cache, {"": b""}, {}

    @staticmethod
    def token_bytes(token: str, end: str) -> bytes:
        """A vocabulary entry as bytes (its letters stand for bytes), 0xFF for a word end."""
        ended = token.endswith(end) and token != end
        core = token[:-len(end)] if ended else token
        return bytes(map(_BYTE_OF.__getitem__, core)) + (b"\xff" if ended else b"")

    def _learn(self, words: set[str]) -> None:
        """Put the ids of ``words``, as little-endian 32-bit numbers, into the cache."""
        plain = []
        for w in words:
            if self._PLAIN.fullmatch(w) and not any(s in w for s in self.special):
                plain.append(w)
            else:
                ids = self.library.encode(w, add_special_tokens=False).ids
                self.cached[w] = array("I", ids).tobytes()
        pieces, merge, made, ends = self.pieces, self.merge, [], []
        for piece in self.find(" ".join(plain).lower()):  # a space ends a word
            if piece == " ":
                ends.append(len(made))
                continue
            ids = pieces.get(piece)
            if ids is None:
                ids = pieces[piece] = array("I", merge(piece.encode() + b"\xff")).tobytes()
            made.append(ids)
        at = 0
        for w, end in zip(plain, ends + [len(made)]):
            self.cached[w] = made[at] if end == at + 1 else b"".join(made[at:end])
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        fresh: set[str] = set()
        for t in texts:
            fresh.update(t.replace("\n", " ").split(" "))
        if len(self.cached) > self.most:  # frequent words are in these texts too
            self.cached = {"": b""} | {w: self.cached[w] for w in fresh if w in self.cached}
            self.pieces = {}
        fresh.difference_update(self.cached.keys())
        self._learn(fresh)
        get = self.cached.__getitem__
        out = [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]
        for w in fresh:
            if len(w) >= 64:
                del self.cached[w]
        return out


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write visible bytes as themselves, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTE_OF = _byte_letters()
_tokenizers: dict[str, WordTokenizer] = {}  # of a Python worker, kept from task to task


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
             with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, 32-bit)."""
    d = pick(docs, doc_id="doc_id", text="text")
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        ids, numbers, starts, pieces = [], [], [], []
        encoded = _tokenizers[path].encode_all([t or "" for t in part.column("text").to_pylist()])
        for doc, whole in zip(part.column("doc_id").to_pylist(), encoded):
            whole += end
            for i, at in enumerate(range(0, len(whole), wide)):
                ids.append(doc)
                numbers.append(i)
                starts.append(at // 4)
                pieces.append(whole[at:at + wide])
        columns = {"doc_id": pa.array(ids, pa.int64()), "piece": pa.array(numbers, pa.int32()),
                   "start": pa.array(starts, pa.int64()),
                   "length": pa.array([len(p) // 4 for p in pieces], pa.int64()),
                   "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64())}
        if with_ids:
            columns["ids"] = pa.array(pieces, pa.binary())
        return pa.RecordBatch.from_pydict(columns)
    return map_blocks(d, run, PIECES + (", ids binary" if with_ids else ""), size=TEXT_BYTES)


class _Lengths:
    """Counts by length, with the order statistics the reduction asks for."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces, one piece of size ``without`` aside."""
        out = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.counts[s] - (s == without))
            if len(out) >= n:
                break
        return out

    def largest(self, most: int, without: int) -> int | None:
        """The largest piece of at most ``most``, one piece of size ``without`` aside."""
        i = bisect_left(self.sizes, most + 1) - 1
        if i >= 0 and self.sizes[i] == without and self.counts[without] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def best_pair(self, most: int, without: int) -> int:
        """The largest total of two pieces within ``most``, one of ``without`` aside; 0 if none."""
        def left(s):
            return self.counts[s] - (s == without)
        lo, hi, best = 0, len(self.sizes) - 1, 0
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > most or not left(b):
                hi -= 1
            elif not left(a) or (a == b and left(a) < 2):
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def fix_dominating(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often, counts that are left)."""
    left, fixed = _Lengths(counts), []
    for s in sorted(left.counts, reverse=True):
        while s in left.counts:
            room = capacity - s
            mate = left.largest(room, s)
            if mate is None:  # nothing fits beside it
                times, sizes = left.counts[s], (s,)
            else:
                small = left.smallest(3, s)
                alone = len(small) < 2 or sum(small[:2]) > room
                pair = not alone and (len(small) < 3 or sum(small) > room) and mate >= left.best_pair(room, s)
                if mate != room and not alone and not pair:
                    break
                sizes = (s, mate)
                times = left.counts[s] // 2 if s == mate else min(left.counts[s], left.counts[mate])
                # taking sets leaves fewer alternatives, so the test holds for every one of them
            fixed.append((sizes, times))
            for x in sizes:
                left.take(x, times)
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (sizes of a bin, bins like it)."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room that is left
    rooms: list[int] = []

    def add(shape, n, room):
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((shape, n))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                shape, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
            else:
                room, shape, n = capacity, (), -(-c // (capacity // s))
            each = room // s
            full = min(n, c // each)
            if full:
                add(shape + (s,) * each, full, room - s * each)
            c -= full * each
            rest = n - full
            if rest and c:  # fewer than ``each`` are left
                add(shape + (s,) * c, 1, room - s * c)
                rest, c = rest - 1, 0
            if rest and shape:
                add(shape, rest, room)
    return [x for shapes in bins.values() for x in shapes]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = fix_dominating(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, pieces a sequence, first sequence, offset),
    sorted: numbers from the first on lie in consecutive sequences."""
    rows, used, sequence = [], {}, 0
    for sizes, times in shapes:
        at = 0
        for s in dict.fromkeys(sizes):
            each = sizes.count(s)
            rows.append((s, used.get(s, 0), each, sequence, at))
            used[s] = used.get(s, 0) + each * times
            at += s * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a long ``length`` of 1 to ``capacity``, ``doc_id``,
    ``piece``, ``ids_crc32``) plus sequence_id and offset."""
    pieces = cut(pieces).withColumn("_part", F.spark_partition_id())
    per_part = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in
              per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    where = slots(plan(counts, capacity))
    keys = where[:, 0] << 44 | where[:, 1]

    by_length = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select(F.col("_part").alias("_p"), F.col("length").alias("_l"),
                            F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (pieces.withColumn("_in", F.row_number().over(within) - 1)
                .join(first, (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l")))
                .withColumn("_number", F.col("_first") + F.col("_in"))
                .drop("_part", "_in", "_p", "_l", "_first"))
    names = [c for c in numbered.columns if c != "_number"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields
                       if f.name != "_number") + ", sequence_id bigint, offset bigint"

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("_number").to_numpy()
            row = where[np.searchsorted(keys, length << 44 | number, "right") - 1] if len(where) else where
            into = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(row[:, 3] + into // row[:, 2]),
                                                pa.array(row[:, 4] + into % row[:, 2] * length)],
                names=[*names, "sequence_id", "offset"])
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    return pack(tokenize(docs, path, capacity, end_id, with_ids), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
