"""Two-stage suffix sorting in numpy, to a bounded depth, and adjacent common prefixes."""

from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix of t, whether it is smaller than the suffix after it. t ends in a 0."""
    up = np.empty(len(t), bool)
    up[-1] = True
    differs = np.flatnonzero(t[:-1] != t[1:])
    own = t[:-1][differs] < t[1:][differs]
    at = np.searchsorted(differs, np.arange(len(t) - 1))
    up[:-1] = np.append(own, True)[at]
    return up


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of t (uint8, ends in a 0) by their first ``depth`` bytes at least.

    Suffixes that are smaller than their successors are sorted directly. The others follow by
    one scan over the buckets of first bytes: whoever stands before a suffix that has its place
    takes the next free place of its own bucket. A bucket is scanned in waves, since it may grow.
    """
    n = len(t)
    small = smaller_than_next(t)
    direct = np.flatnonzero(small)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel(), kind="stable")]
    counts, smalls = np.bincount(t, minlength=256), np.bincount(t[direct], minlength=256)
    start = np.concatenate([[0], np.cumsum(counts)])
    order = np.full(n, -1, np.int64)
    ends = np.concatenate([[0], np.cumsum(smalls)])
    for c in np.flatnonzero(smalls):
        order[start[c + 1] - smalls[c] : start[c + 1]] = direct[ends[c] : ends[c + 1]]
    head = start[:-1].copy()

    def induce(found: np.ndarray) -> None:
        j = found - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if not len(j):
            return
        c = t[j]
        by = np.argsort(c, kind="stable")
        j, c = j[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        order[np.repeat(head[c[first]] - first, size) + np.arange(len(c))] = j
        head[c[first]] += size

    for c in np.flatnonzero(counts):
        at = start[c]
        while at < head[c]:
            stop = head[c]
            induce(order[at:stop])
            at = stop
        induce(order[start[c + 1] - smalls[c] : start[c + 1]])
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before it, up to ``depth``."""
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 4):
        if not len(alive):
            break
        width = min(4, depth - at)
        same = np.ones(len(alive), bool)
        for k in range(at, at + width):
            same &= padded[order[alive] + k] == padded[order[alive - 1] + k]
            out[alive[same]] = k + 1
        alive = alive[same]
    return out
