"""Crochemore's partition refinement over sequences: which factors of one length are equal, length by length.

``squares`` takes several sequences at once and gives, for each length, the places
where a square of that period and of no shorter one starts. Classes of equal
factors of length L + 1 come from those of length L: a class is split by the
classes of the places that follow. Of the parts of a split class all but the
largest split others in the next step, so a place moves at most log2(n) times.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Steps that start from fewer places are done one place at a time; others in whole arrays.
FEW = 48


class Classes:
    """Classes of places with equal factors.

    ``perm`` holds the places class by class (``begin`` and ``end`` by class) in no
    order within one; ``nxt`` and ``prv`` link the places of a class by position.
    Every sequence is followed by an end mark that equals nothing else.
    """

    def __init__(self, sequences: list[np.ndarray], few: int = FEW):
        sizes = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n, self.few = int(self.starts[-1]), few
        names = np.array([int(s.max()) + 2 if len(s) else 1 for s in sequences], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(names)])
        own = [part + base[k] for k, s in enumerate(sequences) for part in (s, np.array([names[k] - 1], dtype=np.int64))]
        self.cls = np.unique(np.concatenate(own), return_inverse=True)[1].astype(np.int64) if own else np.zeros(0, np.int64)
        self.stop = np.repeat(self.starts[1:] - 1, sizes)
        self.perm = np.argsort(self.cls, kind="stable").astype(np.int64)
        self.loc, self.nxt, self.prv = np.empty_like(self.perm), np.full(self.n, -1), np.full(self.n, -1)
        self.loc[self.perm] = np.arange(self.n)
        count = np.bincount(self.cls) if self.n else np.zeros(0, np.int64)
        self.used = len(count)
        self.begin, self.end = np.zeros(2 * self.n, np.int64), np.zeros(2 * self.n, np.int64)  # a class that falls apart wholly leaves its name unused
        self.end[: self.used] = np.cumsum(count)
        self.begin[: self.used] = self.end[: self.used] - count
        self.mark = np.zeros(self.n, bool)
        ordered = self.cls[self.perm]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        self.nxt[self.perm[same]] = self.perm[same + 1]
        self.prv[self.perm[same + 1]] = self.perm[same]
        # the same memory for work on single places, where an array's own access is slow
        self._one = [memoryview(x) for x in (self.cls, self.nxt, self.prv, self.perm, self.loc, self.begin, self.end, self.stop)]

    def split(self, marks) -> tuple[object, np.ndarray, np.ndarray]:
        """The next length: (places of the parts that split others now, places whose neighbour changed, their gaps)."""
        return self._split_few(marks if isinstance(marks, list) else marks.tolist()) if len(marks) < self.few else self._split_many(np.asarray(marks, dtype=np.int64))

    def _split_many(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        p = marks[marks > 0] - 1
        old = self.cls[p]
        live = self.end[old] - self.begin[old] > 1
        p, old = p[live], old[live]
        if not len(p):
            return none, none, none
        by = self.cls[p + 1]
        order = np.lexsort((p, by, old))
        p, old, by = p[order], old[order], by[order]
        first = np.concatenate([[True], (old[1:] != old[:-1]) | (by[1:] != by[:-1])])
        at = np.flatnonzero(first)
        length, owner = np.diff(np.append(at, len(p))), old[at]
        # classes that stay whole: one part, nothing left over
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        moved, parts = np.add.reduceat(length, head), np.diff(np.append(head, len(owner)))
        rest = self.end[owner[head]] - self.begin[owner[head]] - moved
        whole = (rest == 0) & (parts == 1)
        if whole.any():
            kept = np.repeat(~whole, parts)
            p, old = p[np.repeat(kept, length)], old[np.repeat(kept, length)]
            length, owner = length[kept], owner[kept]
            moved, parts, rest = moved[~whole], parts[~whole], rest[~whole]
            if not len(p):
                return none, none, none
            at, head = np.cumsum(length) - length, np.cumsum(parts) - parts
        was = owner[head]
        # out of the old lists: runs of neighbours at once
        r = p[np.lexsort((p, old))]
        tied = self.nxt[r[:-1]] == r[1:]
        a, b = self.prv[r[np.concatenate([[True], ~tied])]], self.nxt[r[np.concatenate([~tied, [True]])]]
        self.nxt[a[a >= 0]] = b[a >= 0]
        self.prv[b[b >= 0]] = a[b >= 0]
        bridged = (a >= 0) & (b >= 0)
        # to the ends of the old classes' stretches
        low = self.end[was] - moved
        low_of = np.repeat(low, moved)
        slot = low_of + np.arange(len(p)) - np.repeat(np.cumsum(moved) - moved, moved)
        self.mark[p] = True
        there = self.perm[slot]
        there = there[~self.mark[there]]
        holes = self.loc[p][self.loc[p] < low_of]
        self.perm[holes], self.loc[there] = there, holes
        self.perm[slot], self.loc[p] = p, slot
        self.mark[p] = False
        new = self.used + np.arange(len(length))
        self.used += len(length)
        self.begin[new], self.end[new] = slot[at], slot[at] + length
        self.end[was] = low
        self.cls[p] = np.repeat(new, length)
        # the new lists
        tied = np.ones(len(p), bool)
        tied[at] = False
        later = np.flatnonzero(tied)
        self.prv[p], self.nxt[p] = -1, -1
        self.prv[p[later]], self.nxt[p[later - 1]] = p[later - 1], p[later]
        changed = np.concatenate([a[bridged], p[later - 1]])
        gaps = np.concatenate([b[bridged] - a[bridged], p[later] - p[later - 1]])
        # all parts but the largest of each class
        most = np.maximum.reduceat(length, head)
        splits = np.ones(len(length), bool)
        largest = np.flatnonzero(length == np.repeat(most, parts))
        of = np.repeat(np.arange(len(head)), parts)[largest]
        lead = largest[np.concatenate([[True], of[1:] != of[:-1]])]
        small_rest = rest < most
        splits[lead[small_rest]] = False
        out = [p[np.repeat(splits, length)]]
        for c in was[small_rest & (rest > 0)]:
            out.append(self.perm[self.begin[c] : self.end[c]])
        return np.concatenate(out), changed, gaps

    def _split_few(self, marks: list[int]) -> tuple[list[int], list[int], list[int]]:
        cls, nxt, prv, perm, loc, begin, end, _ = self._one
        kids: dict[int, dict[int, list[int]]] = {}
        for m in marks:
            if m:
                c = cls[m - 1]
                if end[c] - begin[c] > 1:
                    kids.setdefault(c, {}).setdefault(cls[m], []).append(m - 1)
        out: list[int] = []
        changed: list[int] = []
        gaps: list[int] = []
        for c, groups in kids.items():
            rest = end[c] - begin[c] - sum(map(len, groups.values()))
            if not rest and len(groups) == 1:
                continue
            parts = []
            for members in groups.values():
                members.sort()
                new, e = self.used, end[c]
                self.used += 1
                for p in members:
                    a, b = prv[p], nxt[p]
                    if a >= 0:
                        nxt[a] = b
                    if b >= 0:
                        prv[b] = a
                        if a >= 0:
                            changed.append(a)
                            gaps.append(b - a)
                    e -= 1
                    q, at = perm[e], loc[p]
                    perm[at], loc[q], perm[e], loc[p], cls[p] = q, at, p, e, new
                begin[new], end[new], end[c] = e, end[c], e
                before = -1
                for p in members:
                    prv[p], nxt[p] = before, -1
                    if before >= 0:
                        nxt[before] = p
                        changed.append(before)
                        gaps.append(p - before)
                    before = p
                parts.append(members)
            if rest:
                parts.append(None)
            largest = max(range(len(parts)), key=lambda k: rest if parts[k] is None else len(parts[k]))
            for k, members in enumerate(parts):
                if k != largest:
                    out += perm[begin[c] : end[c]].tolist() if members is None else members
        return out, changed, gaps


class Due:
    """Places by the length at which they may start a square: that of the gap to their neighbour."""

    def __init__(self, classes: Classes):
        self.classes = classes
        self.single: dict[int, list[int]] = defaultdict(list)
        self.sorted: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # a heap of (next gap, number, from, gaps, places)

    def add(self, places, gaps, length: int) -> None:
        """Of these, the ones that can still start a square that ends within its sequence."""
        if isinstance(places, list):
            stop = self.classes._one[7]
            for p, g in zip(places, gaps, strict=True):
                if g >= length and p + 2 * g <= stop[p]:
                    self.single[g].append(p)
            return
        fits = (gaps >= length) & (places + 2 * gaps <= self.classes.stop[places])
        if fits.any():
            order = np.argsort(gaps[fits], kind="stable")
            gaps, places = gaps[fits][order], places[fits][order]
            heapq.heappush(self.sorted, (int(gaps[0]), len(self.sorted) + 1_000_000 * length, 0, gaps, places))

    def at(self, length: int) -> np.ndarray:
        """The places with a neighbour at just this distance now, in order."""
        found = [np.array(self.single.pop(length), dtype=np.int64)] if length in self.single else []
        while self.sorted and self.sorted[0][0] == length:
            _, number, begin, gaps, places = heapq.heappop(self.sorted)
            end = begin + int(np.searchsorted(gaps[begin:], length, side="right"))
            found.append(places[begin:end])
            if end < len(gaps):
                heapq.heappush(self.sorted, (int(gaps[end]), number, end, gaps, places))
        if not found:
            return np.zeros(0, np.int64)
        p = np.unique(np.concatenate(found))
        return p[self.classes.nxt[p] == p + length]


def squares(sequences: list[np.ndarray], few: int = FEW) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places) for each period with squares; places count through all sequences, each with one end mark after it."""
    classes = Classes(sequences, few)
    due, longest = Due(classes), max((len(s) for s in sequences), default=0) // 2
    linked = np.flatnonzero(classes.nxt >= 0)
    due.add(linked, classes.nxt[linked] - linked, 1)
    marks, length = np.arange(classes.n), 1
    while length <= longest:
        p = due.at(length)
        if len(p):
            yield length, p
        if not len(marks):
            return
        marks, changed, gaps = classes.split(marks)
        length += 1
        due.add(changed, gaps, length)


def runs(sequences: list[np.ndarray], least: int = 12, few: int = FEW) -> list[list[tuple[int, int, int]]]:
    """For each sequence its (start, length, period), in this order: stretches of least period that no neighbour extends, of at least two periods and ``least`` places.

    Squares of one period that start one after another are one run.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])]).astype(np.int64)
    for period, p in squares(sequences, few):
        first = np.concatenate([[True], p[1:] != p[:-1] + 1])
        begin, end = p[first], p[np.append(first[1:], True)]
        length = end - begin + 2 * period
        for k in np.flatnonzero(length >= least):
            s = int(np.searchsorted(starts, begin[k], side="right")) - 1
            out[s].append((int(begin[k] - starts[s]), int(length[k]), period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]
