"""Whole-batch scanning of UTF-8 text with numpy.

A batch of texts is looked at as one byte array plus offsets, so words, lines
and n-grams of all its texts are found and hashed by a few array operations and
no Python loop runs over words. White space is ``[\\x20\\x09-\\x0D]`` and lower
case means A-Z only, as all word operators here define them.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; what a scan holds is some ten times as much.
MAX_BYTES = 1_000_000
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P, _P_INV = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_GRAM = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 20)) * _GOLD)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    value = seeds(256, 1)
    return space, lower, value, value[lower]


class Texts:
    """Texts of one batch: bytes, offsets and, lazily, hashes of any of their spans."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first, self.n = buf, off, first, len(off) - 1
        self.space, self.lower, self.value, self.value_lower = _tables()

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def prepare(self, lower: bool) -> None:
        """Prefix sums from which span() takes hashes of spans."""
        powers, inverse = _powers(len(self.buf))
        self._inverse = inverse
        prefix = np.empty(len(self.buf) + 1, np.uint64)
        prefix[0] = 0
        v = (self.value_lower if lower else self.value)[self.buf]
        v *= powers[: len(v)]
        np.cumsum(v, out=prefix[1:])
        self._prefix = prefix

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from start to end."""
        h = (self._prefix[end] - self._prefix[start]) * self._inverse[start]
        return mix(h ^ ((end - start).astype(np.uint64) * _GOLD))

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each text's words begin among them."""
        return self.stretches(~self.space[self.buf])

    def stretches(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all stretches of flagged bytes, none across texts, and where each text's begin among them."""
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.off] = True
        begins, ends = solid.copy(), solid
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines; a text has one more than it has newlines."""
        at = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.off[:-1], at + 1]), kind="stable")
        # an empty text's start sorts beside the start that follows it, and both are equal
        first = np.arange(self.n + 1) + np.searchsorted(at, self.off)
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:] - 1
        end[first[1:] - 1] = self.off[1:]
        return start, end, first


def process_store() -> dict:
    """A dictionary that lives as long as the Python worker and is never pickled."""
    return sys.__dict__.setdefault("_loomveil_store", {})


def release(*keep: str) -> None:
    """Drop what other operators hold in this worker, but for the named entries, and give freed memory back to the system."""
    held = process_store()
    for name in [k for k in held if k not in ("powers", *keep)]:
        del held[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, for 0 to n."""
    kept = process_store()
    if n > MAX_BYTES:  # a text of its own size: not kept
        return tuple(_powers_of(x, n) for x in (_P, _P_INV))
    if "powers" not in kept:
        kept["powers"] = tuple(_powers_of(x, MAX_BYTES) for x in (_P, _P_INV))
    return kept["powers"]


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word or line, from where each text's begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words and where each text's windows begin; none crosses texts."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    g = h[at]
    for k in range(1, n):
        g = g * _GRAM + h[at + k]
    return mix(g), begin


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def by_text(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same text."""
    return mix(h ^ ((owner.astype(np.uint64) + np.uint64(1)) * _GOLD))


def slices(column: pa.Array, most: int = MAX_BYTES) -> Iterator[Texts]:
    """A text column as Texts of at most `most` bytes, or of one longer text; null reads as empty."""
    data = pc.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column, "")
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    _, raw_off, raw = data.buffers()
    off = np.frombuffer(raw_off, np.int64)[data.offset : data.offset + len(data) + 1]
    buf = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(data):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield Texts(buf[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def joined(t: Texts, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each text's kept words joined by one space, the texts' offsets in them and the kept words' starts."""
    at = np.flatnonzero(keep)
    n = np.searchsorted(at, first)  # kept words before each text's
    start, end = start[at], end[at]
    more = np.ones(len(at), bool)
    more[n[1:][np.diff(n) > 0] - 1] = False  # no space behind a text's last kept word
    flag = np.zeros(len(t.buf) + 1, np.int8)
    flag[start] = 1
    flag[end] -= 1
    inside = np.cumsum(flag[:-1], dtype=np.int8).view(bool)
    # a word with another behind it in its text is followed by white space
    out, gap = t.buf.copy(), end[more]
    out[gap], inside[gap] = 0x20, True
    begin = np.concatenate([[0], np.cumsum(end - start + more)])
    return out[inside], begin[n], begin[:-1]


def as_strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts from UTF-8 bytes and offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64).tobytes()), pa.py_buffer(buf.tobytes())])
