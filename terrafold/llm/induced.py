"""External induced sorting: suffix array and common-prefix lengths of a text of integers.

After the eSAIS scheme. Suffixes that are smaller than their successor and preceded by a larger one (S*) are sorted
first: the substrings between them are named in order, and the string of names, at most half as long, is sorted by
recursion unless all names differ. Then two passes over the order being made induce all other suffixes: each suffix
that is scanned puts a tuple for its predecessor into a priority queue, where it waits for its first symbol's turn.

The queue is monotone, so it is kept as first-in-first-out lists by range of symbols, whose overflow is appended to a
file. A tuple carries its suffix and the least common-prefix value between its successor and that of the tuple before
it with the same symbol; one more than that is the common prefix of the two when they come out. A range of several
symbols has at most two blocks of suffixes and is sorted in core; a symbol with more is a range of its own, in which tuples
already come out in order and are passed on block by block.

`memory` bounds what is in core, in numbers of 8 bytes, whatever the length of the text: every array longer than a block
(`memory` / 128) is a mapped file - text, kinds, runs, names, orders, common prefixes, the passes' results - that
is read and written by blocks; the naming sorts by runs of `memory` / 8 merged part by part, and the queue holds as many tuples. Files lose their names
once they are mapped, so they are gone with the process that made them.
"""

import os
import tempfile
from bisect import bisect_left
from collections import deque

import numpy as np

BLOCK = 1 << 16
MEMORY = 1 << 26


class Scratch:
    """Where arrays of a sort live: in core up to a block, else in nameless files of a folder."""

    def __init__(self, folder: str | None = None, memory: int = MEMORY):
        self.root = folder
        self.block, self.run = max(64, memory // 128), max(64, memory // 8)

    def file(self):
        return tempfile.TemporaryFile(dir=self.root)

    def array(self, n: int, dtype=np.int64) -> np.ndarray:
        """n zeros."""
        if self.root is None or n <= self.block:
            return np.zeros(n, dtype)
        with self.file() as f:
            return np.memmap(f, dtype, "w+", shape=n).view(np.ndarray)

    def blocks(self, n: int, first: int = 0):
        step = max(n, 1) if self.root is None else self.block
        for a in range(first, n, step):
            yield a, min(a + step, n)

    def copy(self, a: np.ndarray, dtype=None) -> np.ndarray:
        out = self.array(len(a), dtype or a.dtype)
        for i, j in self.blocks(len(a)):
            out[i:j] = a[i:j]
        return out


class Growing:
    """An array whose length isn't known yet."""

    def __init__(self, scratch: Scratch, dtype=np.int64):
        self.scratch, self.dtype, self.parts, self.n, self.file = scratch, np.dtype(dtype), [], 0, None

    def add(self, a: np.ndarray) -> None:
        self.parts.append(np.asarray(a, self.dtype))
        self.n += len(a)
        if self.scratch.root is not None and sum(map(len, self.parts)) > self.scratch.block:
            self._write()

    def _write(self) -> None:
        self.file = self.file or self.scratch.file()
        for p in self.parts:
            self.file.write(np.ascontiguousarray(p).data)
        self.parts = []

    def done(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        self._write()
        self.file.flush()
        with self.file as f:
            return np.memmap(f, self.dtype, "r+", shape=self.n).view(np.ndarray)


class Queue:
    """Tuples (position, common prefix) by range of symbols, first in first out; ranges are taken in ascending order."""

    def __init__(self, ranges: int, scratch: Scratch):
        self.parts: dict[int, deque] = {}
        self.ranges, self.scratch, self.inside = ranges, scratch, 0
        self.file, self.written, self.flushes = None, 0, []
        self.now, self.flush, self.read = -1, 0, 0

    def put(self, where: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        order = np.argsort(where, kind="stable")
        where, both = where[order], np.stack([pos[order], lcp[order]], axis=1)
        starts = np.flatnonzero(np.append(True, where[1:] != where[:-1])).tolist()
        for a, z in zip(starts, [*starts[1:], len(where)]):
            self.parts.setdefault(int(where[a]), deque()).append(both[a:z])
        self.inside += len(pos)
        if self.scratch.root is not None and self.inside > self.scratch.run:
            self._overflow()

    def _overflow(self) -> None:
        self.file = self.file or self.scratch.file()
        self.file.seek(0, os.SEEK_END)
        sizes = np.zeros(self.ranges + 1, np.int64)
        for r in sorted(self.parts):
            for p in self.parts[r]:
                self.file.write(np.ascontiguousarray(p).data)
                sizes[r + 1] += len(p)
        offsets = self.written + np.cumsum(sizes)
        self.flushes.append(offsets)
        self.written, self.inside, self.parts = int(offsets[-1]), 0, {}

    def take(self, r: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The next tuples of the range, at most so many; none if it has no more for now."""
        if self.now != r:
            self.now, self.flush, self.read = r, 0, 0
        out, n = [], 0
        while n < most:
            if self.flush < len(self.flushes):
                offsets = self.flushes[self.flush]
                a, z = int(offsets[r]) + self.read, int(offsets[r + 1])
                m = min(most - n, z - a)
                if m:
                    self.file.seek(a * 16)
                    out.append(np.frombuffer(self.file.read(m * 16), np.int64).reshape(-1, 2))
                    n, self.read = n + m, self.read + m
                if a + m == z:
                    self.flush, self.read = self.flush + 1, 0
                continue
            held = self.parts.get(r)
            if not held:
                break
            m = min(most - n, len(held[0]))
            out.append(held[0][:m])
            n, self.inside = n + m, self.inside - m
            if m < len(held[0]):
                held[0] = held[0][m:]
            else:
                held.popleft()
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


class Minima:
    """Least value of any stretch: tables of 1 to 32 neighbours, and of blocks of 32 beyond."""

    def __init__(self, a: np.ndarray, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch()
        self.levels = [a]
        while len(self.levels) < 6 and 2 ** len(self.levels) <= len(a):
            self.levels.append(self._wider(self.levels[-1], 2 ** (len(self.levels) - 1)))
        self.blocks = None
        if len(a) > 64:
            b = self.scratch.array(-(-len(a) // 32), a.dtype)
            for i, j in self.scratch.blocks(len(b)):
                b[i:j] = np.minimum.reduceat(a[i * 32 : j * 32], np.arange(0, min(j * 32, len(a)) - i * 32, 32))
            self.blocks = [b]
            while 2 ** len(self.blocks) <= len(b):
                self.blocks.append(self._wider(self.blocks[-1], 2 ** (len(self.blocks) - 1)))

    def _wider(self, m: np.ndarray, s: int) -> np.ndarray:
        out = self.scratch.array(len(m) - s, m.dtype)
        for i, j in self.scratch.blocks(len(out)):
            np.minimum(m[i:j], m[i + s : j + s], out=out[i:j])
        return out

    @staticmethod
    def _over(levels, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        k = np.frexp((z - a).astype(np.float64))[1] - 1
        k = np.minimum(k, len(levels) - 1)
        out = np.empty(len(a), np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            m = levels[level]
            out[at] = np.minimum(m[a[at]], m[z[at] - 2**level])
        return out

    def over(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """min of a[i]:z[i], none of which is empty."""
        long = (z - a) > 64
        if not long.any():
            return self._over(self.levels, a, z)
        out = np.empty(len(a), np.int64)
        s = ~long
        out[s] = self._over(self.levels, a[s], z[s])
        x, y = a[long], z[long]
        edge = np.minimum(self._over(self.levels, x, x + 32), self._over(self.levels, y - 32, y))
        out[long] = np.minimum(edge, self._over(self.blocks, -(-x // 32), y // 32))
        return out


def in_order(key: np.ndarray, value: np.ndarray, scratch: Scratch):
    """(keys, values, the key behind or None) in ascending order of key, by blocks; both arrays are used up."""
    n = len(key)
    if scratch.root is None or n <= scratch.run:
        if n:
            o = np.argsort(key, kind="stable")
            yield key[o], value[o], None
        return
    runs = [(a, min(a + scratch.run, n)) for a in range(0, n, scratch.run)]
    for a, z in runs:
        o = np.argsort(key[a:z], kind="stable")
        key[a:z], value[a:z] = key[a:z][o], value[a:z][o]
    step = max(1, scratch.run // (4 * len(runs)))
    sample = np.sort(np.concatenate([key[a:z:step] for a, z in runs]))
    cuts = np.unique(sample[:: max(1, scratch.run // (2 * step))])

    def parts():
        at = [a for a, _ in runs]
        for c in [*cuts.tolist(), None]:
            ends = [z if c is None else a + int(np.searchsorted(key[a:z], c)) for a, (_, z) in zip(at, runs)]
            k = np.concatenate([key[a:z] for a, z in zip(at, ends)])
            if len(k):
                v = np.concatenate([value[a:z] for a, z in zip(at, ends)])
                o = np.argsort(k, kind="stable")
                yield k[o], v[o]
            at = ends
            if c is None:
                return
            # what equals the cut needs no sorting, however much it is
            ends = [a + int(np.searchsorted(key[a:z], c, "right")) for a, (_, z) in zip(at, runs)]
            for a, z in zip(at, ends):
                for i in range(a, z, scratch.run):
                    yield key[i : min(i + scratch.run, z)], value[i : min(i + scratch.run, z)]
            at = ends

    held = None
    for k, v in parts():
        if held:
            yield (*held, int(k[0]))
        held = k, v
    yield (*held, None)


def _within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of each of the sorted values among those equal to it; first: where each value begins."""
    return np.arange(len(values)) - first[values]


def _ranges(key: np.ndarray, sigma: int, block: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """First symbol of each range, and whether it is a single one with more than a block of suffixes."""
    count = scratch.array(sigma)
    for a, z in scratch.blocks(len(key)):
        u, c = np.unique(key[a:z], return_counts=True)
        count[u] += c
    firsts, bigs = [], []
    before, quotient, was_big = 0, -1, False
    for a, z in scratch.blocks(sigma):
        c = count[a:z]
        q = (before + np.cumsum(c) - c) // block
        big = c > block
        new = (q != np.append(quotient, q[:-1])) | big | np.append(was_big, big[:-1])
        firsts.append(np.flatnonzero(new) + a)
        bigs.append(big[new])
        before, quotient, was_big = before + int(c.sum()), q[-1], bool(big[-1])
    return np.concatenate(firsts), np.concatenate(bigs)


class Bucket:
    """The suffixes of one symbol with more than a block of them, passed on block by block, and the least values between the tuples for each symbol."""

    def __init__(self, key, sigma: int, scratch: Scratch):
        self.key, self.last = key, scratch.array(sigma)  # of each symbol the number of the last suffix it stood before, from 1 on over all buckets
        self.n = 0

    def begin(self) -> None:
        self.start = self.n
        self.at, self.low = np.zeros(0, np.int64), np.zeros(0, np.int64)  # numbers and values that nothing smaller follows

    def pushed(self, pos: np.ndarray, lcp: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, suffix, value) of the tuples that a block of suffixes induces."""
        at = np.flatnonzero(pos > 0)
        j = pos[at] - 1
        kj = self.key[j].astype(np.int64)
        stay = wanted(kj)
        at, j, kj = at[stay], j[stay], kj[stay]
        v = np.zeros(len(at), np.int64)
        if len(at):
            o = np.argsort(kj, kind="stable")
            same = np.append(False, kj[o][1:] == kj[o][:-1])
            least = Minima(lcp)
            two = np.flatnonzero(same)
            if len(two):
                v[o[two]] = least.over(at[o[two - 1]] + 1, at[o[two]] + 1)
            heads = o[~same]
            before = self.last[kj[heads]]
            known = before > self.start
            heads_known = heads[known]
            if len(heads_known):
                here = least.over(np.zeros(len(heads_known), np.int64), at[heads_known] + 1)
                i = np.searchsorted(self.at, before[known], "right")
                v[heads_known] = np.where(i < len(self.at), np.minimum(here, self.low[np.minimum(i, len(self.at) - 1)]) if len(self.at) else here, here)
            ends = o[np.append(~same[1:], True)]
            self.last[kj[ends]] = self.n + at[ends] + 1
        behind = np.minimum.accumulate(lcp[::-1])[::-1]
        keep = np.flatnonzero(np.append(lcp[:-1] < behind[1:], True))
        older = self.low < behind[0]
        self.at, self.low = np.concatenate([self.at[older], self.n + keep + 1]), np.concatenate([self.low[older], lcp[keep]])
        self.n += len(pos)
        return kj, j, v


def induce(key: np.ndarray, sigma: int, seeds: np.ndarray, seed_lcp: np.ndarray, run: np.ndarray, block: int, scratch: Scratch):
    """All suffixes that seeds induce, in order, each with its common prefix with the one before it of the same key (0: none).

    key ascends in the order of the pass; the seeds are in that order and stand behind what is induced with their key.
    """
    if scratch.root is not None:
        block = min(block, scratch.block)
    firsts, bigs = _ranges(key, sigma, block, scratch)
    ends = np.append(firsts[1:], sigma).tolist()
    queue, bucket = Queue(len(firsts), scratch), None
    out_pos, out_lcp = Growing(scratch), Growing(scratch)
    low = s0 = 0
    numbers = range(len(seeds))

    def put(kj, j, v):
        if len(j):
            queue.put(np.searchsorted(firsts, kj, "right") - 1, j, v)

    for r, high in enumerate(ends):
        before, s0 = s0, bisect_left(numbers, high, s0, key=lambda i: key[seeds[i]])
        if bigs[r]:
            bucket = bucket or Bucket(key, sigma, scratch)
            bucket.begin()
            last = None
            while True:
                pos, lcp = queue.take(r, block)
                if not len(pos):
                    break
                lcp = lcp + 1
                if last is None:
                    lcp[0] = 0
                last = pos[-1]
                out_pos.add(pos)
                out_lcp.add(lcp)
                put(*bucket.pushed(pos, lcp, lambda k: k >= low))
            for a in range(before, s0, block):
                pos, lcp = np.array(seeds[a : min(a + block, s0)]), np.array(seed_lcp[a : min(a + block, s0)])
                if a == before:
                    lcp[0] = 0 if last is None else min(run[last], run[pos[0]])
                put(*bucket.pushed(pos, lcp, lambda k: k > low))
            low = high
            continue
        e = queue.take(r, len(key))
        seed, sl = np.array(seeds[before:s0]), np.array(seed_lcp[before:s0])
        m0, m2 = len(e[0]), s0 - before
        if m0 + m2 == 0:
            low = high
            continue
        pos_parts, succ_parts = [e[0], seed], []
        at, here, is_seed = np.arange(m0 + m2), np.concatenate([e[0], seed]), np.arange(m0 + m2) >= m0
        total = m0 + m2
        while len(at):
            inner = here > 0
            at, here, is_seed = at[inner], here[inner], is_seed[inner]
            kj, ki = key[here - 1], key[here]
            own = ((kj > ki) | ((kj == ki) & ~is_seed)) & (kj < high)
            at, here = at[own], here[own] - 1
            if not len(at):
                break
            pos_parts.append(here)
            succ_parts.append(at)
            at = total + np.arange(len(at))
            is_seed = np.zeros(len(at), bool)
            total += len(at)
        pos = np.concatenate(pos_parts)
        succ = np.concatenate(succ_parts) if succ_parts else np.zeros(0, np.int64)
        c = key[pos].astype(np.int64) - low
        width = high - low
        # symbols that occur here are renumbered: a range can have many that don't
        there, c = np.unique(c, return_inverse=True)
        width = len(there)
        c0, c2, c1 = c[:m0], c[m0 : m0 + m2], c[m0 + m2 :]
        n0, n1, n2 = np.bincount(c0, minlength=width), np.bincount(c1, minlength=width), np.bincount(c2, minlength=width)
        every = n0 + n1 + n2
        base = np.cumsum(every) - every
        place = np.empty(total, np.int64)
        o0 = np.argsort(c0, kind="stable")
        place[o0] = base[c0[o0]] + _within(c0[o0], np.cumsum(n0) - n0)
        place[m0 : m0 + m2] = (base + n0 + n1)[c2] + _within(c2, np.cumsum(n2) - n2)
        lcp = np.zeros(total, np.int64)
        v = e[1][o0] + 1
        v[np.append(True, c0[o0][1:] != c0[o0][:-1])[:m0]] = 0
        lcp[place[o0]] = v
        if total > m0 + m2:
            place1 = (base + n0)[c1]
            place[m0 + m2 :] = place1
            start1 = np.cumsum(n1) - n1
            while True:
                o1 = np.lexsort((place[succ], c1))
                new = np.empty(len(o1), np.int64)
                new[o1] = (base + n0)[c1[o1]] + _within(c1[o1], start1)
                if np.array_equal(new, place1):
                    break
                place1 = new
                place[m0 + m2 :] = new
        sorted_pos = np.empty(total, np.int64)
        sorted_pos[place] = pos
        if m2:
            sp = place[m0 : m0 + m2]
            first = np.append(True, c2[1:] != c2[:-1])
            lcp[sp] = np.where(first, 0, sl)
            behind = sp[first & ((n0 + n1)[c2] > 0)]
            lcp[behind] = np.minimum(run[sorted_pos[behind - 1]], run[sorted_pos[behind]])
        if total > m0 + m2:
            # each in-range tuple against the one before it of its symbol, by the values between their successors
            p1, so = place1[o1], place[succ[o1]]
            same = np.append(False, c1[o1][1:] == c1[o1][:-1])
            lcp[p1[~same]] = np.where(n0[c1[o1][~same]] > 0, 1, 0)
            two = np.flatnonzero(same)
            if len(two):
                a, z, to = so[two - 1] + 1, so[two] + 1, p1[two]
                while True:
                    new = 1 + Minima(lcp).over(a, z)
                    if np.array_equal(new, lcp[to]):
                        break
                    lcp[to] = new
        induced = np.ones(total, bool)
        induced[place[m0 : m0 + m2]] = False
        out_pos.add(sorted_pos[induced])
        out_lcp.add(lcp[induced])
        at = np.flatnonzero(sorted_pos > 0)
        j = sorted_pos[at] - 1
        kj = key[j]
        later = kj >= high
        at, j, kj = at[later], j[later], kj[later].astype(np.int64)
        if len(at):
            o = np.argsort(kj, kind="stable")
            same = np.append(False, kj[o][1:] == kj[o][:-1])
            v = np.zeros(len(o), np.int64)
            two = np.flatnonzero(same)
            if len(two):
                v[two] = Minima(lcp).over(at[o[two - 1]] + 1, at[o[two]] + 1)
            put(kj[o], j[o], v)
        low = high
    return out_pos.done(), out_lcp.done()


def _named(text: np.ndarray, sigma: int, small: np.ndarray, stars: np.ndarray, s: Scratch):
    """Names of the substrings from each S* position to the next, in order, and how many symbols of the same kind each name has in common with the one before."""
    m, wide = len(stars), 2 * sigma
    if m * wide >= 1 << 63:
        raise ValueError("a shard of 2^31 symbols or more can't be sorted")
    group, between = s.array(m), s.array(m + 1)  # common prefix at each boundary of groups in the sorted order
    active, depth = s.array(m), 0
    for a, z in s.blocks(m):
        active[a:z] = np.arange(a, z)
    while len(active):
        key = s.array(len(active))
        for a, z in s.blocks(len(active)):
            i = active[a:z]
            at = stars[i] + depth
            key[a:z] = group[i] * wide + text[at].astype(np.int64) * 2 + small[at]
        stay = Growing(s)
        index, before, group_at, class_at = 0, -1, 0, 0
        for k, i, behind in in_order(key, active, s):
            for a, z in s.blocks(len(k)):
                x, own = k[a:z], i[a:z]
                next_key = int(k[z]) if z < len(k) else behind
                g = x // wide
                old = np.append(before, x[:-1])
                new_group, cut = g != old // wide, x != old
                number = index + np.arange(len(x))
                at_group = np.maximum.accumulate(np.where(new_group, number, group_at))
                at_class = np.maximum.accumulate(np.where(cut, number, class_at))
                rank = g + at_class - at_group
                fresh = cut & ~new_group
                between[rank[fresh]] = depth
                group[own] = rank
                alone = cut & np.append(cut[1:], next_key is None or next_key != x[-1])
                length = np.where(own + 1 < m, stars[np.minimum(own + 1, m - 1)] - stars[own] + 1, 1)
                stay.add(own[~alone & (length > depth + 1)])
                index, before, group_at, class_at = index + len(x), int(x[-1]), int(at_group[-1]), int(at_class[-1])
        active, depth = stay.done(), depth + 1
    mark, number, heads = s.array(m, bool), s.array(m), Growing(s)
    for a, z in s.blocks(m):
        mark[group[a:z]] = True
    n = 0
    for a, z in s.blocks(m):
        number[a:z] = n + np.cumsum(mark[a:z])
        heads.add(between[np.flatnonzero(mark[a:z]) + a])
        n = int(number[z - 1])
    names = s.array(m, text.dtype)
    for a, z in s.blocks(m):
        names[a:z] = number[group[a:z]] - 1
    return names, heads.done()


def suffix_array(text: np.ndarray, block: int = BLOCK, memory: int = MEMORY, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp) of a text of numbers from 0 on, of which only the last is 0; lcp[k] is of sa[k - 1] and sa[k]. Without a folder all is in core."""
    s = Scratch(folder, memory)
    return sort(s.copy(text, np.int32 if len(text) < 2**31 else np.int64), block, s)


def _kinds(text: np.ndarray, s: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """How long the run of equal symbols from each position is, and whether its suffix is smaller than the next."""
    n = len(text)
    run, small = s.array(n, np.int32 if n < 2**31 else np.int64), s.array(n, bool)
    end = n - 1
    for a, z in reversed(list(s.blocks(n))):
        t = text[a:z]
        change = np.flatnonzero(np.append(t[1:] != t[:-1], z == n or t[-1] != text[min(z, n - 1)])) + a
        here = np.arange(a, z)
        i = np.searchsorted(change, here)
        ends = np.where(i < len(change), change[np.minimum(i, len(change) - 1)], end) if len(change) else np.full(z - a, end)
        run[a:z] = ends - here + 1
        small[a:z] = t < text[np.minimum(ends + 1, n - 1)]
        end = int(ends[0])
    small[n - 1] = True
    return run, small


def sort(text: np.ndarray, block: int, s: Scratch) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    sigma = max(int(text[a:z].max()) for a, z in s.blocks(n)) + 1
    run, small = _kinds(text, s)
    found = Growing(s)
    for a, z in s.blocks(n, 1):
        found.add(np.flatnonzero(small[a:z] & ~small[a - 1 : z - 1]) + a)
    stars = found.done()
    m = len(stars)
    names, between = _named(text, sigma, small, stars, s)
    del small
    if len(between) == m:
        order, common = s.array(m), s.array(m)
        for a, z in s.blocks(m):
            order[names[a:z]] = np.arange(a, z)
    else:
        order, common = sort(names, block, s)
    seeds, seed_lcp = s.array(m), s.array(m)
    least = Minima(between, s)
    for a, z in s.blocks(m):
        seeds[a:z] = stars[order[a:z]]
    for a, z in s.blocks(m, 1):
        i, j, h = order[a - 1 : z - 1], order[a:z], common[a:z]
        depth = least.over(names[i + h].astype(np.int64) + 1, names[j + h].astype(np.int64) + 1)
        p, q = stars[i + h] + depth, stars[j + h] + depth
        # where only the kinds of two symbols differ, the suffixes go on alike up to the end of the shorter run
        seed_lcp[a:z] = p - stars[i] + np.where(text[p] == text[q], np.minimum(run[p], run[q]), 0)
    del names, between, least, order, common, stars
    large, large_lcp = induce(text, sigma, seeds, seed_lcp, run, block, s)
    del seeds, seed_lcp
    down, mirrored = s.array(len(large)), s.array(n, text.dtype)
    for a, z in s.blocks(len(large), 1):
        down[a:z] = large_lcp[::-1][a - 1 : z - 1]
    for a, z in s.blocks(n):
        mirrored[a:z] = sigma - 1 - text[a:z]
    tiny, tiny_lcp = induce(mirrored, sigma, large[::-1], down, run, block, s)
    del mirrored, down
    # the last suffix, then those of the second pass from the end; both kinds are in order of their symbols
    s_pos, s_lcp, l_key, s_key = s.array(len(tiny) + 1), s.array(len(tiny) + 1), s.array(len(large)), s.array(len(tiny) + 1)
    s_pos[0] = n - 1
    for a, z in s.blocks(len(s_pos), 1):
        s_pos[a:z] = tiny[::-1][a - 1 : z - 1]
    for a, z in s.blocks(len(s_pos), 2):
        s_lcp[a:z] = tiny_lcp[::-1][a - 2 : z - 2]
    for pos, keys in ((large, l_key), (s_pos, s_key)):
        for a, z in s.blocks(len(pos)):
            keys[a:z] = text[pos[a:z]]
    sa, lcp = s.array(n), s.array(n)
    for a, z in s.blocks(len(large)):
        at = np.arange(a, z) + np.searchsorted(s_key, l_key[a:z])
        sa[at], lcp[at] = large[a:z], large_lcp[a:z]
    for a, z in s.blocks(len(s_pos)):
        k = s_key[a:z]
        upto = np.searchsorted(l_key, k, "right")
        at = np.arange(a, z) + upto
        sa[at], lcp[at] = s_pos[a:z], s_lcp[a:z]
        joint = np.flatnonzero(np.append(a == 0 or k[0] != s_key[a - 1], k[1:] != k[:-1]) & (upto > 0))
        joint = joint[l_key[upto[joint] - 1] == k[joint]]
        lcp[at[joint]] = np.minimum(run[large[upto[joint] - 1]], run[s_pos[a + joint]])
    return sa, lcp
