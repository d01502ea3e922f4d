"""Suffix arrays by prefix doubling and permuted longest common prefixes, in whole-array passes.

Suffixes are sorted by as many symbols as fit a 64-bit key, then by twice as many in each pass: the rank of a suffix, followed by the
rank of the suffix that begins where the known symbols end.  A suffix that differs from all others is at its place and leaves,
so a pass sorts only those whose known symbols occur twice, and there are as many passes as the longest repeat has binary digits.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers that end with a single smallest one."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    known = 62 // bits  # symbols in a key
    padded = np.r_[t, np.zeros(known, dtype=t.dtype)].astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for k in range(known):
        key = key << bits | padded[k : k + n]
    sa, rank = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    place = suffix = np.arange(n, dtype=np.int32)  # places not settled yet, and the suffixes that share them out
    while True:
        order = np.argsort(key)
        key, suffix = key[order], suffix[order]
        sa[place] = suffix
        new = np.r_[True, key[1:] != key[:-1], True]
        rank[suffix] = np.maximum.accumulate(np.where(new[:-1], place, 0))  # the first place of its group
        tied = ~(new[:-1] & new[1:])
        place, suffix = place[tied], suffix[tied]
        if not len(place):
            return sa
        # tied suffixes do not reach the last symbol within the known ones, so another follows
        key = rank[suffix].astype(np.int64) << 32 | rank[suffix + known]
        known *= 2


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix sorted before it, and the length of their common prefix.

    A position whose left neighbours agree has one less than the position before it; only the others are compared.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    start = (before < 1) | (here < 1)
    some = np.flatnonzero(~start)
    start[some] = t[some - 1] != t[before[some] - 1]
    out = np.zeros(n, dtype=np.int64)
    todo = np.flatnonzero(start & (before >= 0))
    padded = np.r_[t, np.full(16, -1, dtype=t.dtype)]
    span = np.arange(8)
    other = before[todo]
    size = np.zeros(len(todo), dtype=np.int64)
    live = np.arange(len(todo))
    while len(live):
        a = np.minimum(todo[live] + size[live], n)[:, None] + span
        b = np.minimum(other[live] + size[live], n)[:, None] + span
        agree = (padded[a] == padded[b]) & (padded[a] >= 0)
        run = np.where(agree.all(axis=1), 8, agree.argmin(axis=1))
        size[live] += run
        live = live[run == 8]
    out[todo] = size
    # reducible positions count down from the last compared one
    last = np.maximum.accumulate(np.where(start, here, 0))
    return before, np.maximum(out[last] - (here - last), 0)
