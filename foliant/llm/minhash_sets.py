"""Word shingles of texts, and one-permutation hashes of them."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import xxhash

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(text: str, k: int = 2) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; a shorter text is one run, an empty one none."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]), the same for equal pairs only; less than their count."""
    return np.unique((a << np.int64(32)) | b, return_inverse=True)[1].astype(np.int64)


def shingles(texts: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and hash of each distinct shingle, sorted by text.

    Words are numbered, then pairs of neighbours, pairs of pairs, and so on, so that distinct
    shingles are told apart by their words, not by hashes, and each is one integer, whatever k is.
    """
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    flat: list[int] = []
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        if w:
            flat += map(number.__getitem__, w)
            flat += [0] * (k - len(w))
            size[i] = max(len(w), k) - k + 1
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.array(flat, np.int64)
    del flat
    doc = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(doc)) + (k - 1) * np.repeat(np.cumsum(size > 0) - 1, size)
    # run: a number for the words at i .. i + width - 1; two that overlap make a longer one
    run, width = codes, 1
    while width < k:
        step = min(width, k - width)
        run, width = _ranks(run[:-step], run[step:]), width + step
    bits = int(run.max()).bit_length()
    order = np.argsort((doc << np.int64(bits)) | run[at]) if len(texts).bit_length() + bits < 63 else np.lexsort([run[at], doc])
    key, doc = run[at][order], doc[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    at, doc = at[order[new]], doc[new]
    of_word = np.array([0x51, *map(xxhash.xxh3_64_intdigest, number)], np.uint64)
    h = np.zeros(len(doc), np.uint64)
    for j in range(k):
        h = h * _C[0] + of_word[codes[at + j]]
    return doc, mix(h)


def set_digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n sets: its size, and two 64-bit sums over its members."""
    size = np.bincount(doc, minlength=n)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(doc):
        one[doc[starts]] = np.add.reduceat(h, starts)
        two[doc[starts]] = np.add.reduceat((h ^ (h >> np.uint64(29))) * h, starts)
    return size, one, two


def one_permutation(doc: np.ndarray, h: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins minima. Each member falls into one bin; an empty bin copies the first full one of
    a series of bins drawn for it, the same series in every set (optimal densification)."""
    top = np.uint64(2**64 - 1)
    sig = np.full(n * bins, top)
    at = doc * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, at, h & np.uint64(2**32 - 1))
    sig = sig.reshape(n, bins)
    full = sig != top
    some = full.any(1)
    r, c = np.nonzero(~full & some[:, None])
    t = 0
    while len(r):
        t += 1
        draw = (mix(np.arange(bins, dtype=np.uint64) * _C[0] + np.full(1, t, np.uint64) * _C[3]) % np.uint64(bins)).astype(np.int64)
        from_ = draw[c]
        ok = full[r, from_]
        sig[r[ok], c[ok]] = sig[r[ok], from_[ok]]
        r, c = r[~ok], c[~ok]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys, as signed 64-bit values; the band's number is part of the key."""
    n, bins = sig.shape
    rows = sig.reshape(n, bands, bins // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    for j in range(rows.shape[2]):
        key = mix(key * _C[0] + rows[:, :, j])
    return key.view(np.int64)
