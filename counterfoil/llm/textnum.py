"""Whole texts as numpy arrays: words, word hashes and shingles of a batch.

Spark deals the texts out; these helpers run inside its tasks on one Arrow
batch at a time, cut into blocks of about ``BLOCK_BYTES`` (a longer text is a
block of its own), so memory follows the block and not the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte to lower case for A-Z, itself otherwise.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes to a polynomial: strings as short as this differ by less than 2^64 divides.
PIECE = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
#: Odd factors by place in a shingle.
_PLACE = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 2 ** 63, 64, dtype=np.uint64)]
#: So many powers stay from block to block; those of a longer block are made for it alone.
KEPT_POWERS = (1 << 19) + 4096
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        have = np.full(max(n, KEPT_POWERS), base, np.uint64)
        have[0] = 1
        np.cumprod(have, dtype=np.uint64, out=have)
        if n <= KEPT_POWERS:
            _powers[name] = have
    return have[:n]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES):
    """Slices of ``batch`` of about ``size`` bytes of text, one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


class Block:
    """The texts of a block as one byte array, a space after each text; words
    end at the bytes that ``breaks`` marks."""

    def __init__(self, texts: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        lens = np.diff(offsets)
        self.n = n
        self.at = offsets - offsets[0] + np.arange(n + 1)  # where each text begins, and the end
        self.bytes = np.full(len(data) + n, 0x20, np.uint8)
        self.bytes[np.arange(len(data)) + np.repeat(np.arange(n), lens)] = LOWER[data] if lower else data
        edge = np.flatnonzero(np.diff(np.concatenate([[True], breaks[self.bytes]]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]  # of the words
        self.doc = np.searchsorted(self.at, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=n)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial of every ``PIECE``
        bytes (whole strings of so few bytes have no equal sums by their form),
        mixed; a longer word adds up its pieces, each mixed with its place."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.bytes) + 1
        terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)[:-1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        down = _power("down", _BASE_INVERSE, n)
        size = self.ends - self.starts
        h = (sums[np.minimum(self.ends, self.starts + PIECE)] - sums[self.starts]) * down[self.starts]
        long = np.flatnonzero(size > PIECE)
        if len(long):
            pieces = -(-size[long] // PIECE)
            first = np.cumsum(pieces) - pieces
            place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
            start = np.repeat(self.starts[long], pieces) + place * PIECE
            end = np.minimum(start + PIECE, np.repeat(self.ends[long], pieces))
            part = mix64((sums[end] - sums[start]) * down[start])
            h[long] = np.add.reduceat(mix64(part ^ mix64(place.astype(np.uint64))), first)
        return mix64(h + size.astype(np.uint64))

    def shingles(self, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word's index, hash) of every run of ``width`` words of one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h += hashes[i:i + n] * np.uint64(_PLACE[i % len(_PLACE)])
        inside = self.doc[:n] == self.doc[width - 1:width - 1 + n]
        return np.flatnonzero(inside), mix64(h[inside])


def give_back() -> None:
    """Memory that this worker's allocators hold free goes back to the system:
    workers outlive their tasks, and what they keep adds to later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_blocks(df, body, schema, text: str = "text", size: int = BLOCK_BYTES):
    """``body(block rows as a RecordBatch) -> RecordBatch`` over all of ``df``."""
    def run(batches):
        for batch in batches:
            for part in blocks(batch, text, size):
                yield body(part)
        give_back()
    return df.mapInArrow(run, schema)
