"""Suffix arrays by induced sorting, and permuted common prefixes.

The top level works on bytes and moves whole buckets at a time: suffixes that a bucket induces are dealt out by their
first character in one stable pass, in rounds while a bucket induces into itself. Deeper levels have one character for
each distinct substring, so they run the same induction one suffix at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; the last (the sentinel) is."""
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate((np.concatenate((step, [1]))[ahead] > 0, [True]))


def _deal(sa: np.ndarray, found: np.ndarray, chars: np.ndarray, at: np.ndarray, step: int) -> None:
    """Append suffixes to their buckets in order; at holds each bucket's next free slot and moves on by step."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    counts = np.bincount(sorted_chars, minlength=len(at))
    rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[sorted_chars]
    sa[at[sorted_chars] + step * rank] = found[order]
    at += step * counts


def _induce_buckets(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Sort all suffixes from leftmost-smaller ones that stand in the wished order."""
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(text), -1, np.int32)
    seeds = np.bincount(text[lms], minlength=size)
    order = np.argsort(text[lms], kind="stable")
    chars = text[lms][order]
    sa[(ends - seeds)[chars] + np.arange(len(lms)) - (np.cumsum(seeds) - seeds)[chars]] = lms[order]
    used, head = np.flatnonzero(counts), starts.copy()
    for c in used:
        done = starts[c]
        while True:
            to = head[c]
            if to == done:
                break
            before = sa[done:to] - 1
            done = to
            before = before[before >= 0]
            before = before[~small[before]]
            if len(before):
                _deal(sa, before, text[before], head, 1)
        if seeds[c]:
            before = sa[ends[c] - seeds[c] : ends[c]] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            if len(before):
                _deal(sa, before, text[before], head, 1)
    for c in used:
        if seeds[c]:
            sa[ends[c] - seeds[c] : ends[c]] = -1
    tail = ends - 1
    sa[0] = len(text) - 1
    tail[text[-1]] = -1
    for c in used[::-1]:
        done = ends[c] - 1
        while True:
            to = tail[c]
            if to >= done or to < starts[c] - 1:
                break
            before = sa[to + 1 : done + 1][::-1] - 1
            done = to
            before = before[before >= 0]
            before = before[small[before]]
            if len(before):
                _deal(sa, before, text[before], tail, -1)
        larger = sa[starts[c] : head[c]][::-1]
        before = larger - 1
        before = before[before >= 0]
        before = before[small[before]]
        if len(before):
            _deal(sa, before, text[before], tail, -1)
    return sa


def _induce_each(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same, one suffix at a time. Free slots hold 0, which induces nothing; slots ahead are filled as they are read."""
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    seeds = np.bincount(text[lms], minlength=size)
    order = np.argsort(text[lms], kind="stable")
    chars = text[lms][order]
    first = np.zeros(len(text), np.int32)
    first[(ends - seeds)[chars] + np.arange(len(lms)) - (np.cumsum(seeds) - seeds)[chars]] = lms[order]
    sa = first.tolist()
    before, larger = text[:-1], ~small[:-1]
    bucket, head = [-1, *np.where(larger, before, -1).tolist()], (ends - counts).tolist()
    for p in sa:
        c = bucket[p]
        if c >= 0:
            to = head[c]
            sa[to] = p - 1
            head[c] = to + 1
    bucket, tail = [-1, *np.where(larger, -1, before).tolist()], ends.tolist()
    for p in reversed(sa):
        c = bucket[p]
        if c >= 0:
            tail[c] = to = tail[c] - 1
            sa[to] = p - 1
    return np.array(sa, np.int32)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    return (_induce_buckets if size <= 512 else _induce_each)(text, small, lms, size)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings in text order, equal ones alike."""
    reach = np.zeros(len(text), np.int32)
    reach[lms] = np.concatenate((np.diff(lms), [0])) + 1
    a, b = ordered[:-1], ordered[1:]
    differs = reach[a] != reach[b]
    live = np.flatnonzero(~differs)
    k = 0
    while len(live):
        apart = text[a[live] + k] != text[b[live] + k]
        differs[live[apart]] = True
        k += 1
        live = live[~apart]
        live = live[reach[a[live]] > k]
    rank = np.zeros(len(text), np.int32)
    rank[ordered] = np.concatenate(([0], np.cumsum(differs)))
    return rank[lms], int(differs.sum()) + 1


def _sort(text: np.ndarray, size: int) -> np.ndarray:
    if len(text) < 3:
        return np.arange(len(text), dtype=np.int32)[::-1].copy() if len(text) == 2 else np.arange(len(text), dtype=np.int32)
    small = suffix_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    first = _induce(text, small, lms, size)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names, n = _names(text, lms, ordered)
    if n < len(lms):
        ordered = lms[_sort(names, n)]
    return _induce(text, small, ordered, size)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte array, in order; a suffix sorts before its extensions."""
    if not len(text):
        return np.zeros(0, np.int32)
    return _sort(np.concatenate((text.astype(np.int32) + 1, np.zeros(1, np.int32))), 257)[1:]


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position: bytes shared with the suffix before it in the array, counted up to ``most``."""
    n = len(text)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    live = np.flatnonzero(before >= 0)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    words = np.ndarray((n + most,), "<u8", padded.tobytes(), strides=(1,))
    k = 0
    while k < most and len(live):
        xor = words[live + k] ^ words[before[live] + k]
        same = np.where(xor == 0, 8, 0)
        part = np.flatnonzero(xor)
        low = xor[part] & (~xor[part] + np.uint64(1))
        same[part] = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3
        out[live] = k + same
        live = live[xor == 0]
        k += 8
    last = np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0))
    return np.minimum(np.minimum(out, most), last).astype(np.int32)
