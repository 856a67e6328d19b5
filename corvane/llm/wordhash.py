"""Words, word hashes and word n-gram (shingle) hashes of a batch of texts, in numpy.

A word is a maximal run of characters other than space and U+0009..U+000D;
only ASCII A-Z are lower-cased.  Both rules act on single bytes of UTF-8, so a
whole Arrow batch is handled as one byte buffer without a Python loop.

Hashes are 64-bit and depend on the bytes alone (no process seed), so every
executor, retry and rerun computes the same ones.

Defined cases: a null text and a text of white space have no words; a text with
fewer words than the n-gram length has one shingle, its whole word sequence.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def seeds(n: int, tag: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers of the family ``tag``."""
    base = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(tag) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(base) | np.uint64(1)


_BYTE = seeds(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x5851F42D4C957F2D


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    p = 1
    for i in range(n):
        out[i] = p
        p = (p * _STEP) & _MASK
    return out


_POW = _powers(1 << 10)


def _weights(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(1 << int(n - 1).bit_length())
    return _POW


def scan_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts, in order: hashes and first bytes in the batch's buffer; the buffer; words of each text.

    The buffer holds the texts as UTF-8, each with a space behind it.
    """
    rows = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.zeros(len(rows), dtype=np.int64)
    whole = np.frombuffer(b" ".join([*rows, b""]), dtype=np.uint8)
    space = _SPACE[whole]
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, whole, counts
    bounds = np.cumsum([len(r) + 1 for r in rows])
    counts = np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)
    # place of each byte within its word; white space adds nothing
    lead = int(starts[0])
    place = np.arange(lead, len(whole), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(whole))))
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[whole[lead:]]] * _weights(int(place.max()) + 1)[place]
        value[space[lead:]] = 0
        sums = np.add.reduceat(value, starts - lead)
    return mix64(sums), starts, whole, counts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words of each text."""
    hashes, _, _, counts = scan_words(texts)
    return hashes, counts


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (48 bits) of each text, sorted within a text, and their number.

    Two of a text's n shingles share a hash with a probability of about n * n / 2^49: under one in a million for 20,000 words.
    """
    words, counts = word_hashes(texts)
    mult = seeds(n, 2)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.uint64), sizes
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
    with np.errstate(over="ignore"):
        acc = np.full(total, 0, dtype=np.uint64)
        have = counts[owner]
        for k in range(n):
            ok = have > k
            acc += np.where(ok, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) * mult[k]
        acc = mix64(acc + np.minimum(have, n).astype(np.uint64))
    # one integer sort for the whole batch: the text's number above 48 bits of hash
    if len(counts) >= 1 << 16:
        raise ValueError("at most 65535 texts a batch")
    packed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (acc >> np.uint64(16)))
    keep = np.ones(total, dtype=bool)
    keep[1:] = packed[1:] != packed[:-1]
    packed = packed[keep]
    sizes = np.bincount((packed >> np.uint64(48)).astype(np.int64), minlength=len(counts)).astype(np.int64)
    return packed & np.uint64((1 << 48) - 1), sizes


def minhash(values: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """``k`` min-hash coordinates of each non-empty set, 32 bits each; rows of empty sets are 0."""
    out = np.zeros((len(sizes), k), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full) == 0:
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    mult = seeds(k, 3)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = values * mult[j]
            h ^= h >> np.uint64(32)
            h *= mult[k - 1 - j]
            out[full, j] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
    return out
