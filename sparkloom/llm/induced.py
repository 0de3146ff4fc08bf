"""Suffix order and common prefixes by recursive induced sorting with disk-backed queues.

Suffixes are typed; those that begin with a local minimum (LMS) are sorted by recursion on names of
the pieces between them, and all others are induced: a scan in rising order queues the larger-typed
predecessors, a scan in falling order the smaller-typed ones. A queue carries (suffix, common prefix
with the entry before it) tuples; a predecessor's value is one more than the least value since the
last push to the same queue. Small alphabets are scanned a bucket at a time with arrays; the large
alphabets of the recursion go through a priority queue of integers. Both spill to files.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

from sparkloom.llm.common import mix64

#: Entries that a queue keeps in memory before it writes to a file.
MEMORY_ENTRIES = 4_000_000
BIG = np.int32(1 << 30)
#: The common prefix that is tried first.
FIRST_TRY = 15


class BucketQueue:
    """First-in first-out arrays of (suffix, common prefix), on disk beyond a number of entries."""

    def __init__(self, memory: int = MEMORY_ENTRIES):
        self.parts: list = []
        self.memory, self.held, self.size = memory, 0, 0
        self.file = None

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.size += len(pos)
        if self.held + len(pos) > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(pos.astype("<i8").tobytes() + lcp.astype("<i4").tobytes())
            self.parts.append((at, len(pos)))
            return
        self.held += len(pos)
        self.parts.append((pos, lcp))

    def take(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.parts[k]
        if isinstance(part[0], int):
            at, n = part
            self.file.seek(at)
            data = self.file.read(12 * n)
            return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i4", n, 8 * n)
        return part

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        got = [self.take(k) for k in range(len(self.parts))]
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])


class IntHeap:
    """A priority queue of integers; beyond a size the heap is sorted into a run on disk."""

    def __init__(self, memory: int = MEMORY_ENTRIES):
        self.heap: list[int] = []
        self.memory = memory
        self.runs: list = []

    def push(self, x: int) -> None:
        if len(self.heap) >= self.memory:
            self._spill()
        heapq.heappush(self.heap, x)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for x in sorted(self.heap):
            file.write(x.to_bytes(16, "little"))
        file.seek(0)
        self.heap = []
        run = [None, file]
        self._next(run)
        self.runs.append(run)

    @staticmethod
    def _next(run: list) -> None:
        data = run[1].read(16)
        run[0] = int.from_bytes(data, "little") if data else None

    def pop(self) -> int | None:
        if not self.runs:
            return heapq.heappop(self.heap) if self.heap else None
        run = min((r for r in self.runs if r[0] is not None), key=lambda r: r[0], default=None)
        if run is None or (self.heap and self.heap[0] < run[0]):
            return heapq.heappop(self.heap) if self.heap else None
        out = run[0]
        self._next(run)
        return out


def alphabet(t: np.ndarray) -> np.ndarray:
    """The characters of t, rising; they are not negative, and names are at most as large as t is long."""
    return np.flatnonzero(np.bincount(t)) if t.max(initial=0) <= max(len(t), 1 << 16) else np.unique(t)


def places(marks: np.ndarray) -> np.ndarray:
    """Where marks stand, in 32 bits where they fit."""
    return np.flatnonzero(marks).astype(np.int32 if len(marks) < (1 << 31) - 1 else np.int64)


def types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the length of its first run."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    small = np.append(t[ends[:-1] + 1] > t[ends[:-1]], True)
    return small[own], (ends[own] - np.arange(n) + 1).astype(np.int32)


def _scatter(queues: dict, pend: dict, pos: np.ndarray, lcp: np.ndarray, keep: np.ndarray, t: np.ndarray, carry: bool) -> None:
    """Queue the kept entries' predecessors by their first character, in order."""
    at = np.flatnonzero(keep)
    if carry and len(lcp):
        least = lcp.min()
        for d in pend:
            if pend[d] > least:
                pend[d] = least if d not in queues else pend[d]
    if not len(at):
        if carry and len(lcp):
            for d in pend:
                pend[d] = min(pend[d], least)
        return
    before = pos[at] - 1
    chars = t[before]
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    cuts = np.append(np.flatnonzero(np.append(True, sorted_chars[1:] != sorted_chars[:-1])), len(order))
    pushed = set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        d = int(sorted_chars[a])
        own = order[a:b]
        queue = queues.get(d)
        first = queue is None
        if first:
            queue = queues[d] = BucketQueue()
        if carry:
            index = at[own]
            starts = np.append(0, index[:-1] + 1)
            values = np.minimum.reduceat(lcp[: index[-1] + 1], starts)
            if first:
                values[0] = 0
            else:
                values[0] = min(values[0], pend.get(d, BIG)) + 1
            values[1:] += 1
            rest = lcp[index[-1] + 1 :]
            pend[d] = rest.min() if len(rest) else BIG
            pushed.add(d)
        else:
            values = np.zeros(len(own), np.int32)
        queue.push(before[own], values.astype(np.int32))
    if carry:
        for d in pend:
            if d not in pushed:
                pend[d] = min(pend[d], least)


def induce(t: np.ndarray, small: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order from LMS suffixes in order, with common prefixes if those are given."""
    carry = seed_lcp is not None
    n = len(t)
    chars = alphabet(t)
    seed_chars = t[seeds]
    lo, hi = np.searchsorted(seed_chars, chars), np.searchsorted(seed_chars, chars, "right")
    queues: dict[int, BucketQueue] = {}
    pend: dict[int, int] = {}
    for c, a, b in zip(chars.tolist(), lo, hi, strict=True):
        k, last = 0, None
        while (queue := queues.get(c)) is not None and k < len(queue.parts):
            pos, lcp = queue.take(k)
            k += 1
            last = pos[-1]
            _scatter(queues, pend, pos, lcp, (pos > 0) & ~small[pos - 1], t, carry)
        if b > a:
            pos = seeds[a:b]
            lcp = seed_lcp[a:b].copy() if carry else np.zeros(b - a, np.int32)
            if carry:
                lcp[0] = 0 if last is None else min(runs[last], runs[pos[0]])
            _scatter(queues, pend, pos, lcp, (pos > 0) & ~small[pos - 1], t, carry)
    large = queues
    queues, pend = {}, {}
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in chars[::-1].tolist():
        if c == int(t[n - 1]) and c == int(chars[0]):
            out.append((np.array([n - 1]), np.zeros(1, np.int32)))  # the end itself
            break
        k, last = 0, None
        while (queue := queues.get(c)) is not None and k < len(queue.parts):
            pos, lcp = queue.take(k)
            k += 1
            last = pos[-1]
            _scatter(queues, pend, pos, lcp, (pos > 0) & small[pos - 1], t, carry)
        s_pos, s_lcp = queue.all() if queue is not None else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        l_pos, l_lcp = large[c].all() if c in large else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        seam = min(runs[l_pos[-1]], runs[last]) if len(l_pos) and last is not None else 0
        if len(l_pos):
            back = l_pos[::-1]
            lcp = np.append(seam, l_lcp[:0:-1]).astype(np.int32)
            _scatter(queues, pend, back, lcp, (back > 0) & small[back - 1], t, carry)
        # in rising order: large-typed, then small-typed from the last queued to the first
        rise = s_pos[::-1]
        rise_lcp = np.append(seam, s_lcp[:0:-1]).astype(np.int32) if len(s_pos) else s_lcp
        if len(s_pos):
            rise_lcp = np.append(seam if len(l_pos) else 0, s_lcp[:0:-1]).astype(np.int32)
        out.append((np.concatenate([l_pos, rise]), np.concatenate([l_lcp, rise_lcp])))
    out.reverse()
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def induce_heap(t: list[int], small: list[bool], seeds: list[int]) -> list[int]:
    """The same order for large alphabets, one suffix at a time through a priority queue."""
    n = len(t)
    heap = IntHeap()
    for k, p in enumerate(seeds):
        heap.push((((t[p] << 1) | 1) << 72) | (k << 36) | p)
    mask = (1 << 36) - 1
    count, large = 0, []
    while (x := heap.pop()) is not None:
        p = x & mask
        if not (x >> 72) & 1:
            large.append(p)
        if p and not small[p - 1]:
            heap.push(((t[p - 1] << 1) << 72) | (count << 36) | (p - 1))
            count += 1
    # falling scan: keys are turned round; small-typed entries come before large-typed ones of a character
    top = max(t) + 1
    for k, p in enumerate(reversed(large)):
        heap.push(((((top - t[p]) << 1) | 1) << 72) | (k << 36) | p)
    count, out = 0, []
    while (x := heap.pop()) is not None:
        p = x & mask
        out.append(p)
        if p and small[p - 1]:
            heap.push((((top - t[p - 1]) << 1) << 72) | (count << 36) | (p - 1))
            count += 1
    out.append(n - 1)
    out.reverse()
    return out


def induce_buckets(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> list[int]:
    """As induce_heap, while all entries fit in memory: a queue for each character in one list."""

    def leads(kept: np.ndarray) -> list[int]:
        """The character before each suffix, or -1 where none is kept; the last one stands for places without a suffix, -1."""
        return np.concatenate([[-1], np.where(kept, t[:-1], -1), [-1]]).tolist()

    counts = np.bincount(t)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), ends.tolist()
    out = [-1] * len(t)
    for p, c in zip(seeds[::-1].tolist(), t[seeds[::-1]].tolist(), strict=True):
        tail[c] -= 1
        out[tail[c]] = p
    # the list is read where it has been filled by then
    before = leads(~small[:-1])
    for p in out:
        c = before[p]
        if c >= 0:
            at = head[c]
            out[at] = p - 1
            head[c] = at + 1
    tail = ends.tolist()
    before = leads(small[:-1])
    for p in reversed(out):
        c = before[p]
        if c >= 0:
            at = tail[c] - 1
            out[at] = p - 1
            tail[c] = at
    out[0] = len(t) - 1
    return out


class IntSpans:
    """Hashes of spans of an integer array."""

    def __init__(self, t: np.ndarray):
        n = len(t) + 1
        base = 0x9E6C63D0876A9A35
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(mix64(t.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.prefix[1:])
        powers[:] = pow(base, -1, 1 << 64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.inverse = powers

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def induce_large(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    if len(t) <= MEMORY_ENTRIES:
        return np.array(induce_buckets(t, small, seeds), seeds.dtype)
    return np.array(induce_heap(t.tolist(), small.tolist(), seeds.tolist()), np.int64)


def sort_lms(t: np.ndarray, small: np.ndarray, runs: np.ndarray, spans: IntSpans) -> np.ndarray:
    """LMS suffixes in order."""
    lms = places(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return lms
    rough = lms[np.argsort(t[lms], kind="stable")]
    if len(alphabet(t)) * 24 < len(t):
        order, _ = induce(t, small, runs, rough, None)
    else:
        order = induce_large(t, small, rough)
    del rough
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    rank = (np.cumsum(is_lms, dtype=lms.dtype) - 1)[order]
    ends = np.append(lms[1:] + 1, len(t))
    names = spans(lms, ends)[rank]
    new = np.append(True, names[1:] != names[:-1])
    if new.all():
        return order
    reduced = np.empty(len(lms), np.int64)
    reduced[rank] = np.cumsum(new) - 1
    del is_lms, order, rank, ends, names, new
    inner, inner_runs = types(reduced)
    inner_spans = IntSpans(reduced)
    found = sort_lms(reduced, inner, inner_runs, inner_spans)
    del inner_spans
    if len(alphabet(reduced)) * 24 < len(reduced):
        whole, _ = induce(reduced, inner, inner_runs, found, None)
    else:
        whole = induce_large(reduced, inner, found)
    return lms[whole]


def suffix_order(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t in order and each one's common prefix with the one before, right up to ``cap``.

    t ends with a value that is smaller than all others. The prefixes of neighbouring LMS suffixes
    are measured by halving over span hashes; all others are carried through the induction.
    """
    if len(t) < 2:
        return np.arange(len(t)), np.zeros(len(t), np.int32)
    small, runs = types(t)
    spans = IntSpans(t)
    lms = sort_lms(t, small, runs, spans)
    lcp = np.zeros(len(lms), np.int32)
    if len(lms) > 1:
        a, b = lms[:-1], lms[1:]
        lo = np.zeros(len(a), np.int64)
        hi = np.minimum(len(t) - np.maximum(a, b), cap + 1)
        # most are short, so that a short length is tried first, and only open ones are tried again
        mid = np.minimum(hi, FIRST_TRY)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            x, y, m = a[open_], b[open_], mid[open_]
            same = spans(x, x + m) == spans(y, y + m)
            lo[open_[same]] = m[same]
            hi[open_[~same]] = m[~same] - 1
            open_ = open_[lo[open_] < hi[open_]]
            mid[open_] = (lo[open_] + hi[open_] + 1) // 2
        lcp[1:] = lo
        del a, b, lo, hi, mid
    del spans
    return induce(t, small, runs, lms, lcp)


def repeated_windows(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, the starts of its windows of ``width`` bytes that also start elsewhere here."""
    sizes = np.array([len(s) for s in strings], np.int64)
    # bytes from 2, a 1 after each string, a 0 at the end, in 16 bits, which sort by radix
    ends = np.cumsum(sizes + 1)
    t = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int16)
    t[ends - 1] = 1
    t[:-1][t[:-1] == 0] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 2
    order, lcp = suffix_order(t, width)
    long = lcp >= width
    hit = long.copy()
    hit[:-1] |= long[1:]
    found = np.zeros(len(t), bool)
    found[order[hit]] = True
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = []
    for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        out.append(np.flatnonzero(found[at : at + max(0, size - width + 1)]))
    return out
