"""Problem 9: evaluation passages in training documents.

Short n-grams of the passages that few items share are the seeds. Documents are scanned once for them (a vectorised
rolling hash over whole texts). Seeds that a document shares with an item on neighbouring diagonals, that is in about
the same order and distance, join the two; enough of them, and the pair is aligned by Smith-Waterman over words. Long
n-grams of LEAK words count however many items share them, so no passage is missed because its short n-grams are
common. A text with every fourth word replaced still has its seeds; one with every third replaced may have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm import words as W
from mnemolith.session import arrow_map, spread, table

#: Words of a seed and of one in Chinese, and the number of items up to which a seed is rare.
SEED, SEED_ZH, RARE = 3, 6, 2
#: A pair is aligned when, within BAND diagonals, it shares so many seeds, and a tenth of the seeds the item has.
SEEDS, PART, BAND = 3, 0.1, 16
#: Consecutive words that make a leak, and those for items in Chinese.
LEAK, LEAK_ZH = 13, 20
#: Alignment: reward of a match, cost of a mismatch and of a gap, and least share of the best score of an edited copy.
MATCH, MISMATCH, GAP, SHARE = 2, 1, 1, 0.5
#: Items are broadcast in blocks of at most so many words.
BLOCK_WORDS = 400_000

_PRIMES = (np.random.Generator(np.random.PCG64(99)).integers(0, 2**62, 32, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def rolling(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the n-grams without a 0."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    at = np.flatnonzero(known[n:] - known[:-n] == n)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h += ids[at + k] * _PRIMES[k]
        h ^= h >> np.uint64(29)
    return at, h


class Items:
    """Passages by word numbers, and their seeds by hash, each with the items and the places where it stands."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.names, self.words, self.least, self.need = [], [], [], []
        grams: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in (SEED, SEED_ZH, LEAK, LEAK_ZH)}
        for name, lang, passage in rows:
            found = W.words_or_han(passage)
            if name is None or not found:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            k, zh = len(self.names), (lang or "").lower() == "zh"
            self.names.append(name), self.words.append(ids), self.least.append(LEAK_ZH if zh else LEAK)
            self.need.append(max(SEEDS, PART * len(ids)))
            for n in (SEED_ZH, LEAK_ZH) if zh else (SEED, LEAK):
                at, hashes = rolling(ids, n)
                for q, h in zip(at.tolist(), hashes.tolist()):
                    grams[n].setdefault(h, []).append((k, q))
        self.seeds = []
        for n, by in grams.items():
            rare = n in (SEED, SEED_ZH)
            kept = {h: owners for h, owners in by.items() if not rare or len({k for k, _ in owners}) <= RARE}
            order = np.array(sorted(kept), np.uint64)
            sizes = np.array([len(kept[h]) for h in order.tolist()], np.int64)
            flat = np.array([o for h in order.tolist() for o in kept[h]], np.int64).reshape(-1, 2)
            self.seeds.append((n, rare, order, np.concatenate([[0], np.cumsum(sizes)]), flat[:, 0], flat[:, 1]))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(longest run of common words, best Smith-Waterman score) of two word sequences."""
    steps = np.arange(len(b) + 1) * GAP
    score, run = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    best = longest = 0
    for w in a:
        same = b == w
        diagonal = score[:-1] + np.where(same, MATCH, -MISMATCH)
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, score[1:] - GAP), 0)
        row = np.maximum.accumulate(row + steps) - steps
        following = np.zeros(len(b) + 1, np.int64)
        following[1:] = np.where(same, run[:-1] + 1, 0)
        score, run = row, following
        best, longest = max(best, int(row.max())), max(longest, int(run.max()))
    return longest, best


def _hits(ids: np.ndarray, begin: np.ndarray, n: int, rare: bool, order: np.ndarray, at: np.ndarray, owners: np.ndarray, places: np.ndarray):
    """(rare, document, item, place in the documents, place in the item) of every seed of n words found."""
    none = np.empty(0, np.int64)
    p, h = rolling(ids, n) if len(order) else (none, none)
    if not len(p):
        return rare, none, none, none, none
    where = np.minimum(np.searchsorted(order, h), len(order) - 1)
    hit = np.flatnonzero(order[where] == h)
    seed, p = where[hit], p[hit]
    times = at[seed + 1] - at[seed]
    entry = np.repeat(at[seed] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    p = np.repeat(p, times)
    return rare, np.searchsorted(begin, p, "right") - 1, owners[entry], p, places[entry]


def _scan(batch: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    get = items.vocabulary.get
    texts = [W.words_or_han(t) for t in batch.column("text").to_pylist()]
    gap = [0] * LEAK_ZH
    flat: list[int] = []
    begins = []
    for found in texts:
        begins.append(len(flat))
        flat.extend([get(w, 0) for w in found])
        flat.extend(gap)
    ids = np.array(flat, np.uint64)
    begin = np.array(begins, np.int64)
    spans: dict[tuple[int, int], list[int]] = {}
    hits = [_hits(ids, begin, *seed) for seed in items.seeds]
    need = np.array(items.need)
    for rare, d, k, p, q in hits:
        if rare and len(d):
            # seeds by diagonal, in bands that overlap by half
            half = (p - q + (1 << 40)) // (BAND // 2)
            group = np.concatenate([np.stack([d, k, half]), np.stack([d, k, half - 1])], axis=1)
            where = np.tile(np.arange(len(d)), 2)
            order = np.lexsort(group)
            group, where = group[:, order], where[order]
            edge = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
            count = np.diff(np.append(edge, group.shape[1]))
            strong = np.repeat(count >= need[group[1, edge]], count)
            kept = np.unique(where[strong])
            d, k, p, q = d[kept], k[kept], p[kept], q[kept]
        for a, b, first in zip(d.tolist(), k.tolist(), (p - q).tolist()):
            span = spans.get((a, b))
            if span is None:
                spans[a, b] = [first, first]
            else:
                span[0], span[1] = min(span[0], first), max(span[1], first)
    names = batch.column("doc_id").to_pylist()
    rows = []
    for (d, k), (low, high) in spans.items():
        item = items.words[k]
        # the item laid on the first and the last of its diagonals, with room for what was inserted
        low = max(begins[d], low - len(item) // 2)
        high = min(begins[d] + len(texts[d]), high + len(item) + len(item) // 2)
        longest, score = align(item, ids[low:high])
        share = score / (MATCH * len(item))
        if longest >= items.least[k] or share >= SHARE:
            rows.append((names[d], items.names[k], longest, round(share, 4), longest >= items.least[k]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "item_id", "longest_run", "share", "verbatim"])


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_run, share, verbatim): the items that leaked into each document.

    verbatim: at least LEAK consecutive words are shared (LEAK_ZH for an item in Chinese, where every Han character is
    a word); otherwise the alignment reaches SHARE of the item's best score. Null and empty texts and passages match
    nothing; repeated rows of a document give one row; the items, a fixed set, are broadcast in blocks of BLOCK_WORDS.
    """
    rows, size, blocks = [], 0, []
    for r in eval_items.select("item_id", "lang", "passage").toLocalIterator():
        rows.append(tuple(r))
        size += len(r["passage"] or "") // 4
        if size > BLOCK_WORDS:
            blocks.append(rows)
            rows, size = [], 0
    blocks.append(rows)
    texts = spread(documents.where("text IS NOT NULL").select(documents.doc_id.cast("long").alias("doc_id"), "text"))
    out = None
    for block in blocks:
        items = Items(block)
        part = arrow_map(texts, lambda batch, items=items: _scan(batch, items), "doc_id long, item_id long, longest_run int, share double, verbatim boolean")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("verbatim", "longest_run", "share")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.longest_run", "m.share", "m.verbatim")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("verbatim").select("doc_id", "item_id")
