"""Quality rules as a short-circuit cascade.

Every text gets its base measures.  Texts that pass the base rules go through
further rules, in the order of rejection per cost: a bounded sample of
``sample_rows`` documents tells what each rule costs and how many it rejects,
and a rule sees only what the rules before it left.  A document is kept if no
rule rejects it, so the sample decides the order (the work), never the result.

Defined results: a null or empty text has no words and fails the base rules;
lines without a word are never duplicates; repeated rows are judged alike; an
empty table gives an empty result (and the rules keep their written order).
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table
from .textnum import Block, blocks, map_blocks, mix64

WINDOW = 5
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])
SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean")


def repeated_words(block: Block, hashes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text: words inside a run of ``width`` words that the text has twice or more."""
    at, runs = block.shingles(width, hashes)
    if not len(at):
        return np.zeros(block.n, np.int64)
    keys = mix64(runs ^ mix64(block.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return np.bincount(block.doc[np.cumsum(edge[:-1]) > 0], minlength=block.n)


def duplicate_lines(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word that equal an earlier line, lines with a word) per text."""
    dup, all_lines = [], []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        dup.append(len(lines) - len(set(lines)))
        all_lines.append(len(lines))
    return np.array(dup, np.int64), np.array(all_lines, np.int64)


class Measures:
    """A block's texts with their base measures; the rest on demand."""

    def __init__(self, texts: pa.Array):
        self.block = b = Block(texts)
        self.hashes = b.word_hashes()
        self.n_words = b.n_words
        self.word_chars = b.per_text(~_CONTINUES[b.bytes] & _in_words(b))
        self.n_symbols = b.per_text(_SYMBOL[b.bytes])
        self.n_dup_lines, self.n_lines = duplicate_lines(texts.to_pylist())
        self.n_repeat_words = repeated_words(b, self.hashes)

    def words_of(self, alive: np.ndarray) -> np.ndarray:
        return np.flatnonzero(alive[self.block.doc])


def _in_words(b: Block) -> np.ndarray:
    edge = np.zeros(len(b.bytes) + 1, np.int8)
    edge[b.starts] += 1
    edge[b.ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def word_length(m: Measures, alive):
    """Mean word length outside 2.5 to 13 characters."""
    return (2 * m.word_chars < 5 * m.n_words) | (m.word_chars > 13 * m.n_words)


def symbols(m: Measures, alive):
    """More than a symbol for ten words."""
    return 10 * m.n_symbols > m.n_words


def same_lines(m: Measures, alive):
    """More than two fifths of the lines repeat earlier ones."""
    return 5 * m.n_dup_lines > 2 * m.n_lines


def echoes(m: Measures, alive):
    """More than three tenths of the words repeat the word before."""
    w = m.words_of(alive)
    pair = w[1:][(m.hashes[w[1:]] == m.hashes[w[1:] - 1]) & (m.block.doc[w[1:]] == m.block.doc[w[1:] - 1])]
    return 10 * np.bincount(m.block.doc[pair], minlength=m.block.n) > 3 * m.n_words


def letters(m: Measures, alive):
    """Fewer than 55 % of the words have a letter."""
    w = m.words_of(alive)
    sums = np.concatenate([[0], np.cumsum(_LETTER[m.block.bytes], dtype=np.int64)])
    has = w[sums[m.block.ends[w]] > sums[m.block.starts[w]]]
    return 100 * np.bincount(m.block.doc[has], minlength=m.block.n) < 55 * m.n_words


RULES = (word_length, symbols, same_lines, echoes, letters)


def base_failed(m: Measures) -> np.ndarray:
    return (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = 512) -> list[int]:
    """Places of ``rules`` by rejections per second on at most ``sample_rows`` rows."""
    def estimate(batches):
        for batch in batches:
            for part in blocks(batch):
                m = Measures(part.column("text"))
                alive = ~base_failed(m)
                took, hit = [], []
                for rule in rules:
                    t = time.perf_counter()
                    hit.append(int((rule(m, alive) & alive).sum()))
                    took.append(time.perf_counter() - t)
                yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "hit": hit, "took": took})
    found = (docs.select("text").limit(sample_rows).mapInArrow(estimate, "rule bigint, hit bigint, took double")
             .groupBy("rule").agg(F.sum("hit").alias("hit"), F.sum("took").alias("took")).collect())
    gain = {r["rule"]: r["hit"] / max(r["took"], 1e-9) for r in found}
    return sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))


def judge_quality(docs: DataFrame, rules=RULES, sample_rows: int = 512) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, one row a document."""
    d = pick(docs, doc_id="doc_id", text="text")
    ordered = [rules[i] for i in rule_order(d, rules, sample_rows)]

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        m = Measures(part.column("text"))
        failed = base_failed(m)
        alive = ~failed
        for rule in ordered:
            if not alive.any():
                break
            alive &= ~rule(m, alive)
        return pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id").cast(pa.int64()), "n_words": m.n_words.astype(np.int64),
            "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines,
            "n_repeat_words": m.n_repeat_words.astype(np.int64), "base_failed": failed, "kept": alive})
    return map_blocks(d, judge, SCHEMA)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
