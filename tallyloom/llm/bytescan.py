"""Words of UTF-8 bytes as they lie in an Arrow column: spans, and hash tables that compare the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tallyloom.llm.words import mix

SLICE_BYTES = 4 << 20
#: Bytes of a span that are held as numbers; what lies beyond is compared as bytes.
_PARTS = 4
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without NULLs, and where each text starts (the end of the last one too)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, "<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at


def slices(at: np.ndarray, limit: int | None = None):
    """Ranges of texts that hold about ``limit`` bytes; a longer text is alone."""
    limit, lo, n = limit or SLICE_BYTES, 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def pieces(buf: np.ndarray, lo: int, hi: int, may_cut: np.ndarray, limit: int | None = None):
    """Ranges of about ``limit`` bytes from ``lo`` to ``hi`` that end after a byte where ``may_cut`` (a table) holds.

    A stretch without such a byte stays whole.
    """
    limit = limit or SLICE_BYTES
    while hi - lo > limit:
        cut = np.flatnonzero(may_cut[buf[lo : lo + limit]])
        if len(cut):
            end = lo + int(cut[-1]) + 1
        else:
            end = lo + limit
            while end < hi and not may_cut[buf[end - 1]]:
                step = np.flatnonzero(may_cut[buf[end : min(hi, end + limit)]])
                end = end + int(step[0]) + 1 if len(step) else min(hi, end + limit)
        yield lo, end
        lo = end
    if hi > lo:
        yield lo, hi


def runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no place of ``edges``."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[edges] = True
    before = np.append(False, inside[:-1]) & ~edge[:-1]
    after = np.append(inside[1:], False) & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Spans:
    """Byte ranges as numbers: size, the first bytes eight at a time, and a hash. ``group`` tells equal bytes apart."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None):
        self.buf, self.start, self.size, self.group = buf, start, end - start, group
        eight = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
        self.parts: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            h = self.size.astype(np.uint64) * _ODD
            if group is not None:
                h += mix(group.astype(np.uint64) + np.uint64(1))
            for k in range(_PARTS):
                some = np.flatnonzero(self.size > 8 * k)
                if k and not len(some):
                    break
                value = np.zeros(len(start), np.uint64)
                value[some] = eight[start[some] + 8 * k] & _MASK[np.minimum(self.size[some] - 8 * k, 8)]
                self.parts.append(value)
                h = mix(h ^ value) if not k else np.where(self.size > 8 * k, mix(h ^ value), h)
        for i in np.flatnonzero(self.size > 8 * _PARTS).tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.bytes(i)))
        self.hash = h

    def __len__(self) -> int:
        return len(self.start)

    def bytes(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def equal(self, i: np.ndarray, other: Spans, j: np.ndarray) -> np.ndarray:
        """Whether spans ``i`` are the spans ``j`` of ``other``, byte by byte."""
        same = self.size[i] == other.size[j]
        if self.group is not None:
            same &= self.group[i] == other.group[j]
        for a, b in zip(self.parts, other.parts):
            same &= a[i] == b[j]
        for n in np.flatnonzero(same & (self.size[i] > 8 * _PARTS)).tolist():
            same[n] = self.bytes(int(i[n])) == other.bytes(int(j[n]))
        return same


class SpanTable:
    """A hash table with open places: ``owner`` gives each span the first span with the same bytes (and group)."""

    def __init__(self, spans: Spans):
        self.spans, n = spans, len(spans)
        self.bits = max(4, (2 * n).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.owner = np.full(n, -1, np.int64)
        todo, slot = np.arange(n), self._slots(spans)
        while len(todo):
            held = self.table[slot]
            free = held < 0
            self.table[slot[free][::-1]] = todo[free][::-1]  # of several spans the first stays
            held = self.table[slot]
            same = held == todo
            rest = np.flatnonzero(~same)
            same[rest] = spans.equal(todo[rest], spans, held[rest])
            self.owner[todo[same]] = held[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.table) - 1)

    def _slots(self, spans: Spans) -> np.ndarray:
        return (spans.hash >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, spans: Spans) -> np.ndarray:
        """For each span the number of the equal span in the table, or -1."""
        found = np.full(len(spans), -1, np.int64)
        todo, slot = np.arange(len(spans)), self._slots(spans)
        while len(todo):
            held = self.table[slot]
            live = held >= 0
            todo, slot, held = todo[live], slot[live], held[live]
            same = spans.equal(todo, self.spans, held)
            found[todo[same]] = held[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.table) - 1)
        return found


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(b: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(dtype)
