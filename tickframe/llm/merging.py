"""Rank-driven pair merging with a heap over a doubly linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush


def merge(seq, rank) -> list[int]:
    """Merge adjacent symbols of ``seq`` (a str or bytes) until no adjacent pair has a rank.

    ``rank`` gives the rank of a concatenation or None; the lowest goes first, the
    leftmost among equals.  The linked list is held in two arrays: ``after[i]`` is
    where the symbol that starts at ``i`` ends (0: swallowed) and ``before[i]``
    where the one to its left starts.  Returns ``after``; the live symbols are
    those reached from 0.  O(n log n)."""
    n = len(seq)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        r = rank(seq[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        mid = after[i]
        if not mid or mid >= end or after[mid] != end:
            continue
        after[i] = end
        after[mid] = 0
        if end < n:
            before[end] = i
            wider = after[end]
            r = rank(seq[i:wider])
            if r is not None:
                heappush(heap, (r, i, wider))
        left = before[i]
        if left >= 0:
            r = rank(seq[left:end])
            if r is not None:
                heappush(heap, (r, left, end))
    return after


def symbols(seq, after: list[int]) -> list:
    """The live symbols after ``merge``."""
    out, i, n = [], 0, len(seq)
    while i < n:
        j = after[i]
        out.append(seq[i:j])
        i = j
    return out
