"""Words of whole Arrow columns at once: boundaries and 64-bit hashes by numpy over the UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, `_` and characters from U+00C0 on, without general punctuation
(U+2000-207F) and CJK punctuation (U+3000-303F). Case is folded by code point, so positions in characters stay.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words for Python, Java and RE2.
WORD_CLASS = "0-9A-Za-z_À-῿₀-⿿぀-\U0010ffff"
WORD = re.compile(f"[{WORD_CLASS}]+")

_R = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, dtype=np.uint64)
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_ASCII_WORD[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
P = 0x9E3779B97F4A7C15
Q = 0xD6E8FEB86659FD93
_M = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, base & _M, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if m <= 1 << 22:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(arr: pa.Array, limit: int = 1 << 20):
    """Runs of rows of up to `limit` bytes of text, a longer text alone: (first row, part)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, arr.slice(at, to - at)
        at = to


class Words:
    """Words of a slice: hash, and of each document the first word in `first` (one more entry than documents).

    With `every` also what stands between words, but for ASCII blanks, in runs; CJK and astral characters are then words of their own.
    """

    def __init__(self, arr: pa.Array, every: bool = False):
        arr = pc.utf8_lower(pc.fill_null(arr, "")).cast(pa.large_string())
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        raw = arr.buffers()[2]
        b = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        n = len(b)
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        w = word[1:-1]
        w[:] = _ASCII_WORD[b]
        if n and b.max() >= 128:
            lead = np.flatnonzero((b == 0xC2) | (b == 0xE2) | (b == 0xE3))
            if len(lead):
                nxt = b[np.minimum(lead + 1, n - 1)]
                kind = b[lead]
                two = lead[kind == 0xC2]
                three = lead[((kind == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((kind == 0xE3) & (nxt == 0x80))]
                w[two] = False
                w[two + 1] = False
                for k in range(3):
                    w[three + k] = False
        if every:
            self.start, self.end = self._tokens(b, off, w)
        else:
            edge = word[1:] != word[:-1]
            inner = off[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            joined = np.unique(inner[word[inner] & word[inner + 1]])  # two documents whose words touch, empty ones between them or not
            at = np.flatnonzero(edge)
            if len(joined):
                at = np.sort(np.concatenate([at, joined, joined]))
            self.start, self.end = at[0::2], at[1::2]
        pre = np.zeros(n + 1, np.uint64)
        np.cumsum(_R[b] * powers(P, n), out=pre[1:])
        h = (pre[self.end] - pre[self.start]) * powers(inverse(P), n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, off)
        self.bytes, self.off = b, off

    @staticmethod
    def _tokens(b: np.ndarray, off: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(b)
        blank = _BLANK[b]
        new = np.zeros(n + 4, bool)
        new[1:n] = (w[1:] != w[:-1]) | blank[:-1]
        new[off] = True
        if n and b.max() >= 0xE3:
            nxt = np.append(b[1:], np.uint8(0))
            for lead, size in ((w & (b > 0xE2) & (b < 0xEA) & ((b > 0xE3) | (nxt > 0x80)), 3), (w & (b > 0xEF), 4)):
                at = np.flatnonzero(lead)
                new[at] = new[at + size] = True
        start = np.flatnonzero(new[:n] & ~blank)
        gaps = np.append(np.flatnonzero(blank), n)
        return start, np.minimum(np.append(start[1:], n), gaps[np.searchsorted(gaps, start)])

    def grams(self, n: int, mult: int = Q) -> np.ndarray:
        """Hash of the n words from each word on; of no meaning where those pass the document's end."""
        t = len(self.hash)
        pre = np.zeros(t + 1, np.uint64)
        np.cumsum(self.hash * powers(mult, t), out=pre[1:])
        to = np.minimum(np.arange(n, t + n), t)
        return mix((pre[to] - pre[:-1]) * powers(inverse(mult), t))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def whole(self, mult: int) -> np.ndarray:
        """A hash of each document's sequence of words."""
        t = len(self.hash)
        pre = np.zeros(t + 1, np.uint64)
        np.cumsum(self.hash * powers(mult, t), out=pre[1:])
        a, z = self.first[:-1], self.first[1:]
        return mix((pre[z] - pre[a]) * powers(inverse(mult), t + 1)[a] + (z - a).astype(np.uint64))


def words(text: str | None) -> list[str]:
    """The slow way, of one text."""
    if text is None:
        return []
    return WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py())
