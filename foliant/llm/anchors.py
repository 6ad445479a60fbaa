"""Content-defined anchors of byte strings: any two equal windows have the same anchor.

Of the ``K``-byte grams that begin in a window, the anchor is the leftmost of the smallest hash.
So the windows of a text fall into runs, one for each anchor, and equal windows lie equally far
from equal anchors.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a window, and of the grams that are hashed.
WINDOW, K = 100, 28

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_random = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, r in enumerate((_BASE, _INVERSE)):
            x = np.full(1 << (n - 1).bit_length(), r)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class Rolling:
    """Hashes of any substrings of a byte string, in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scatter((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return scatter((self.sums[k:] - self.sums[:n]) * self.down[:n])


def runs(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Runs of windows with one anchor, in texts that stand one after the other in ``data``.

    ``ends`` has where each text ends. Gives each run's first and last window start and its
    anchor's place (all in ``data``), the anchor's hash, and the hasher. Windows don't cross texts.
    """
    n = len(data) - window + 1
    rolling = Rolling(data)
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), rolling
    h = rolling.all(k)
    place = np.uint64(2**32 - 1)
    # the upper half of a hash and its place: smaller values win, then the leftmost
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    w = window - k + 1
    x = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
    x[: len(key)] = key
    x = x.reshape(-1, w)
    prefix = np.minimum.accumulate(x, 1).ravel()
    suffix = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n]) & place).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - window + 1) : e] = False
    new = np.flatnonzero(valid & np.concatenate([[True], (at[1:] != at[:-1]) | ~valid[:-1]]))
    last = np.flatnonzero(valid & np.concatenate([(at[1:] != at[:-1]) | ~valid[1:], [True]]))
    return new, last, at[new], h[at[new]], rolling
