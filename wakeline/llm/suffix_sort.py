"""Suffix arrays of byte strings by induced sorting, as whole-array numpy steps.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the
leftmost S suffixes of each run (LMS) are put in order, first by their substrings and
then, through the string of substring names, recursively; the array of all suffixes
is induced from them in linear time.  Inducing bytes goes bucket by bucket and handles
all entries of a bucket that are known so far in one step; inducing names, of which
there are very many, goes entry by entry.
"""

from __future__ import annotations

import numpy as np

from .common import prefix_sums, span_hash

#: Letters beyond this many are induced one entry after another: buckets are then too small for array steps.
MOST_BUCKETS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end is smaller than all."""
    n = len(t)
    diff = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(n, bool)
    if len(diff):
        small = t[diff] < t[diff + 1]
        out[: diff[-1] + 1] = np.repeat(small, np.diff(np.concatenate([[-1], diff])))
    return out


def _push(sa, ends, t, items, step):
    """Append items to their buckets in order: upwards from ends (step 1) or downwards (step -1)."""
    c = t[items]
    order = np.argsort(c, kind="stable")
    c, items = c[order], items[order]
    first = np.concatenate([[True], c[1:] != c[:-1]])
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(c)))
    place = np.arange(len(c)) - np.repeat(heads, size)
    sa[ends[c] + step * place] = items
    ends[c[heads]] += step * size


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from LMS suffixes in order (or of their substrings, from any order in their buckets)."""
    n, k = len(t), len(starts) - 1
    sa = np.empty(n, np.int64)
    # LMS suffixes of each bucket, in the order given
    by_bucket = lms[np.argsort(t[lms], kind="stable")]
    cut = np.searchsorted(t[by_bucket], np.arange(k + 1))
    head = starts[:-1].copy()
    sa[head[t[n - 1]]] = n - 1  # before the end: an L suffix
    head[t[n - 1]] += 1
    for c in range(k):
        done = starts[c]
        while done < head[c]:
            new = sa[done : head[c]] - 1
            done = head[c]
            new = new[new >= 0]
            new = new[~small[new]]
            if len(new):
                _push(sa, head, t, new, 1)
        new = by_bucket[cut[c] : cut[c + 1]] - 1
        new = new[new >= 0]  # what precedes an LMS suffix is an L suffix
        if len(new):
            _push(sa, head, t, new, 1)
    tail = starts[1:] - 1
    for c in range(k - 1, -1, -1):
        done = starts[c + 1] - 1
        while done > tail[c]:
            new = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            new = new[new >= 0]
            new = new[small[new]]
            if len(new):
                _push(sa, tail, t, new, -1)
        new = sa[starts[c] : head[c]][::-1] - 1
        new = new[new >= 0]
        new = new[small[new]]
        if len(new):
            _push(sa, tail, t, new, -1)
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same as _induce, entry by entry."""
    n, letters, is_small = len(t), t.tolist(), small.tolist()
    sa = [-1] * n
    tail = (starts[1:] - 1).tolist()
    for i in reversed(lms.tolist()):
        c = letters[i]
        sa[tail[c]] = i
        tail[c] -= 1
    head = starts[:-1].tolist()
    sa[head[letters[-1]]] = n - 1
    head[letters[-1]] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = letters[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (starts[1:] - 1).tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = letters[j]
            sa[tail[c]] = j
            tail[c] -= 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Starts of the suffixes of t (values below k) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    induce = _induce if k <= MOST_BUCKETS else _induce_singly
    small = _types(t)
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        # 1. LMS substrings in order, by inducing from LMS suffixes in any order
        sa = induce(t, small, starts, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        # 2. names: equal substrings (to the next LMS suffix, included) get the same
        stop = np.full(n, n)
        stop[lms[:-1]] = lms[1:] + 1
        if t.dtype == np.uint8:
            h = span_hash(prefix_sums(t), order, stop[order])
        else:
            h = _span_ids(t, order, stop[order])
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | ((stop - np.arange(n))[order][1:] != (stop - np.arange(n))[order][:-1])])
        fresh[order == lms[-1]] = True  # the last one meets the end
        last = np.flatnonzero(order == lms[-1])[0]
        if last + 1 < len(order):
            fresh[last + 1] = True
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(fresh) - 1
        reduced, count = name[lms], int(fresh.sum())
        # 3. the LMS suffixes in order, by the suffixes of the string of names
        if count == len(lms):
            lms = order
        else:
            lms = lms[suffix_array(reduced, count)]
    return induce(t, small, starts, lms)


def _span_ids(t, start, stop):
    """A hash of each span of a string of names."""
    from .common import mix

    p = np.cumprod(np.full(len(t) + 1, 0x9E3779B97F4A7C15, np.uint64))
    back = np.cumprod(np.full(len(t) + 1, pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t.astype(np.uint64) + np.uint64(1)) * p[: len(t)])])
    return mix((sums[stop] - sums[start]) * back[start])


def permuted_common_prefixes(t: np.ndarray, start: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of ``start`` (in text order), how many bytes it shares with the one
    before it in suffix order, up to ``most``; both have that many bytes."""
    n = len(t)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word[: n - j] |= t[j:].astype(np.uint64) << np.uint64(8 * j)
    out = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    for at in range(0, most, 8):
        x = word[start[live] + at] ^ word[before[live] + at]
        differ = x != 0
        # the lowest byte that differs
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[live[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
    out[live] = most
    return np.minimum(out, most)
