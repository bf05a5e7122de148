"""Words of a text, and sketches of word multisets.

A multiset of words is turned into a set by numbering the occurrences of a word: (word, 1), (word, 2), ... The
Jaccard similarity of two such sets is the sum of the smaller counts divided by the sum of the larger ones.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import xxhash


def _class_of(category: str) -> str:
    """A regular-expression class of a general category, from the character database."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == category]
    runs, start = [], 0
    for k in range(1, len(points) + 1):
        if k == len(points) or points[k] != points[k - 1] + 1:
            runs.append(f"{re.escape(chr(points[start]))}-{re.escape(chr(points[k - 1]))}")
            start = k
    return "[" + "".join(runs) + "]+"


_MARKS = re.compile(_class_of("Mn"))
_LATIN_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_HAN = re.compile(r"[㐀-鿿]|(?:(?![㐀-鿿])[^\W_])+")
_INVISIBLE = re.compile("[­​]+")
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: Below this code point the only marks after decomposition are U+0300 to U+036F.
_BELOW = re.compile("[^\x00-˿ -⁯₠-₿]")


def folded(text: str) -> str:
    """Text without U+00AD and U+200B, decomposed, without non-spacing marks, in lower case."""
    if text.isascii():
        return text.lower()
    plain = _BELOW.search(text) is None
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    return (_LATIN_MARKS if plain else _MARKS).sub("", text).lower()


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = folded(text)
        if not text.isascii():
            return _WORD.findall(text)
    return text.encode().translate(_ASCII).decode().split()


def words_or_han(text: str | None) -> list[str]:
    """Words, where every character from U+3400 to U+9FFF is one by itself."""
    if not text:
        return []
    if not text.isascii():
        text = folded(text)
        if not text.isascii():
            return _WORD_OR_HAN.findall(text)
    return text.encode().translate(_ASCII).decode().split()


class _Hashes(dict):
    """64-bit hashes of words; the cache is emptied when it is full, which changes no value."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


HASHES = _Hashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(found: list[str]) -> np.ndarray:
    """The 64-bit hashes of (word, occurrence), sorted."""
    counts = Counter(found)
    out = np.fromiter(map(HASHES.__getitem__, counts), np.uint64, len(counts))
    if len(counts) < len(found):
        # the second and later occurrences
        more = np.fromiter(counts.values(), np.int64, len(counts)) - 1
        nth = np.arange(1, len(found) - len(counts) + 1) - np.repeat(np.cumsum(more) - more, more)
        mixed = np.repeat(out, more) + nth.astype(np.uint64) * _STEP
        mixed ^= mixed >> np.uint64(31)
        out = np.concatenate([out, mixed * np.uint64(0xBF58476D1CE4E5B9)])
    out.sort()
    return out


def similarity(a: list[str], b: list[str]) -> float:
    """Sum of the smaller counts over sum of the larger ones; 0 for two empty texts."""
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common) if a or b else 0.0


#: Keys of a text, MinHash values per key, and values that give a bit each of the first and second sketch.
KEYS, DEPTH, BITS = 50, 9, (64, 128)
_RNG = np.random.Generator(np.random.PCG64(20240201))
_MIX = _RNG.integers(0, 2**63, KEYS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_MIX = _RNG.integers(0, 2**63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Tokens handled at once; a longer text is handled alone.
_FLAT = 16_000


def runs(sizes: np.ndarray, most: int = _FLAT) -> list[tuple[int, int]]:
    """Consecutive texts (from, to) of at most so many tokens together."""
    out, start, held = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            out.append((start, k))
            start, held = k, 0
        held += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def minhashes(found: list[np.ndarray], orders: int = KEYS * DEPTH) -> np.ndarray:
    """(orders, texts): the smallest rank of every non-empty token set under each order, all texts at once.

    Order j ranks tokens by their hash times an odd constant; two sets agree in it with the probability of their
    similarity, whatever their sizes.
    """
    out = np.empty((orders, len(found)), np.uint64)
    for a, b in runs(np.array([len(t) for t in found])):
        flat = np.concatenate(found[a:b])
        at = np.cumsum([0, *(len(t) for t in found[a : b - 1])])
        rank = np.empty_like(flat)
        for j in range(orders):
            np.multiply(flat, _MIX[j], out=rank)
            np.minimum.reduceat(rank, at, out=out[j, a:b])
    return out


def sketches(found: list[np.ndarray], keyed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(texts, KEYS) keys of 32 bits and (texts, sum(BITS) / 64) words of bits of non-empty token sets.

    A key combines DEPTH values, so two sets of similarity s agree in a key with probability s ** DEPTH, and in a bit
    with (1 + s) / 2. Without keyed there are no keys.
    """
    low = minhashes(found, KEYS * DEPTH if keyed else sum(BITS))
    bits = ((low[: sum(BITS)] * _STEP) >> np.uint64(41)) & np.uint64(1)
    packed = np.packbits(np.ascontiguousarray(bits.T).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
    if not keyed:
        return np.empty((len(found), 0), np.int32), packed
    low = low.reshape(KEYS, DEPTH, -1)
    keys = ((low ^ (low >> np.uint64(29))) * _KEY_MIX[None, :, None]).sum(axis=1, dtype=np.uint64) * _STEP
    return np.ascontiguousarray((keys >> np.uint64(32)).astype(np.uint32).view(np.int32).T), packed


#: Segments of a text, about, and the factor between length classes: lengths that S >= 0.8 allows lie in two of them.
SEGMENTS, RATIO = 40, 1.25**2
#: Fewest tokens of a segment that is stored or probed.
LEAST_TOKENS = 4


def length_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1) / 12 * (1 + 1e-12)) / np.log(RATIO)).astype(np.int64)


def other_class(n: np.ndarray) -> np.ndarray:
    """The one other class that holds lengths from 0.8 n to 1.25 n."""
    own = length_class(n)
    middle = 12 * RATIO ** (own + 0.5)
    return np.where(n < middle, own - 1, own + 1)


def cuts(cls: int) -> tuple[int, int]:
    """(segments of a string, orders) of a length class: 4 tokens a segment in short texts, about 8 in longer ones."""
    middle = 12 * RATIO ** (cls + 0.5)
    number = max(1, round(middle / (4 if middle < 30 else 6 if middle < 60 else 7.5)))
    return number, max(1, -(-SEGMENTS // number))


def segments(found: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    """The segments of each text as hashes of 32 bits, cut as strings of the given length class; 0 where there is none.

    The strings of a text are its tokens in each of several fixed orders. A string's segments are the parts of it
    between fixed ranks, as many as its class has, so the place of a segment in the list names the order and the ranks.
    Where one order alone has more than SEGMENTS, the first SEGMENTS are taken; one of fewer than LEAST_TOKENS is left
    out.
    """
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(found)
    for cls in np.unique(classes).tolist():
        mine = np.flatnonzero(classes == cls)
        number, orders = cuts(cls)
        taken = min(number, SEGMENTS)
        for a, b in runs(np.array([len(found[k]) for k in mine])):
            part = [found[k] for k in mine[a:b]]
            flat = np.concatenate(part)
            owner = np.repeat(np.arange(len(part), dtype=np.int64), [len(t) for t in part])
            size, rows = len(part) * taken, []
            for r in range(orders):
                rank = flat * _MIX[r]
                place = ((rank >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)
                bins = owner * taken + place
                token = (rank ^ (rank >> np.uint64(31))) * _STEP
                if taken < number:
                    kept = place < taken
                    bins, token = bins[kept], token[kept]
                # sums of 32-bit halves are exact in doubles
                low = np.bincount(bins, (token & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
                high = np.bincount(bins, (token >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
                count = np.bincount(bins, minlength=size)
                key = (low ^ (high * _KEY_MIX[0])) * _KEY_MIX[1]
                key = (key >> np.uint64(32)) | np.uint64(1)
                key[count < LEAST_TOKENS] = 0
                rows.append(key.astype(np.uint32).view(np.int32).reshape(len(part), taken))
            for text, row in zip(mine[a:b].tolist(), np.concatenate(rows, axis=1)):
                out[text] = row
    return out
