"""Vectorised scans of whole UTF-8 texts: words, windows of words, lines.

Every scan works on *blocks*: the contiguous bytes of some consecutive rows of
an Arrow batch, about ``BLOCK_BYTES`` of them (a longer text makes a block of its
own, so no text is ever cut).  Memory is bounded by the block, not by the batch.

Hashes are 64-bit polynomial hashes with a finaliser.  They are built from prefix
sums, so the cost per byte does not depend on word or window length; sums are held for a
chunk of values at a time, so a very long text costs no more memory a byte than its words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection with good diffusion)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


CHUNK = 1 << 17  # values whose prefix sums are held at once


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as a chunk needs."""

    def __init__(self, base: int):
        self.base = base

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = (np.full(CHUNK + 1, b, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _lut(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Words of letters, digits and code points from 0x80; words of non-blanks.
ALNUM = _lut(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
NONBLANK = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@functools.lru_cache(2)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64))
    return v[LOWER] if lower else v


def span_hash(values, powers: _Powers):
    """``get(start, end)`` gives the hashes of spans of values(a, b) in order of their starts, by prefix sums chunk by chunk."""
    up, down = powers.tables

    def sums_of(a: int, b: int) -> np.ndarray:
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values(a, b) * up[: b - a], out=sums[1:])
        return sums

    def long(a: int, b: int) -> int:
        """Of a span longer than a chunk: its parts' sums, each times the power at its place."""
        total = 0
        for at in range(a, b, CHUNK):
            total += int(sums_of(at, min(b, at + CHUNK))[-1]) * pow(powers.base, at - a, 1 << 64)
        return total & 0xFFFFFFFFFFFFFFFF

    def get(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        reach = np.maximum.accumulate(end) if len(end) else end
        i = 0
        while i < len(start):
            a = int(start[i])
            j = int(np.searchsorted(reach, a + CHUNK, "right"))
            if j <= i:
                out[i] = long(a, int(end[i]))
                i += 1
                continue
            sums, at = sums_of(a, int(reach[j - 1])), start[i:j] - a
            out[i:j] = (sums[end[i:j] - a] - sums[at]) * down[at]
            i = j
        return mix(out)

    return get


def prefix_hash(values: np.ndarray, powers: _Powers):
    return span_hash(lambda a, b: values[a:b], powers)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column; of several that clash, the first."""
    return batch.column(batch.schema.names.index(name))


def blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES):
    """(first row, end row, bytes, offsets) of consecutive rows; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of a block: byte ranges, hashes and each row's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool, hashes: bool = True):
        self.data, self.offs = data, offs
        n, filled = len(data), offs[:-1][offs[:-1] < offs[1:]]
        if n:
            inside = kind[data]
            before = np.empty(n, bool)
            before[0], before[1:] = False, inside[:-1]
            before[filled] = False
            self.starts = np.flatnonzero(inside & ~before)
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, inside[1:]
            after[filled[filled > 0] - 1] = False
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offs) - 1), self.counts)
        if hashes:
            self.hash = span_hash(lambda a, b: _byte_values(lower)[data[a:b]], _bytes)(self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words of one row."""
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, prefix_hash(self.hash, _words)(at, at + k)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words [start, end); equal to windows() for equal words."""
        return prefix_hash(self.hash, _words)(start, end)

    def covered(self, start: np.ndarray, k) -> np.ndarray:
        """For each word, whether one of the windows [start, start + k) covers it."""
        edge = np.zeros(len(self) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + k, -1)
        return np.cumsum(edge[:-1]) > 0

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each word, by row."""
        return row_sums(values, self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): whether an equal key of the same row stands earlier; whether it occurs twice."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((keys, rows))
    same = np.zeros(n, bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, both = np.zeros(n, bool), np.zeros(n, bool)
    later[order], both[order] = same, twice
    return later, both


class Lines:
    """The ``\\n``-split lines of a block (every row has one line at least)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        row = np.searchsorted(offs, breaks, "right") - 1
        rows = len(offs) - 1
        self.counts = np.bincount(row, minlength=rows).astype(np.int64) + 1
        self.row = np.repeat(np.arange(rows), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        head = np.zeros(int(self.first[-1]), bool)
        head[self.first[:-1]] = True
        tail = np.zeros(len(head), bool)
        tail[self.first[1:] - 1] = True
        self.starts, self.ends = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        self.starts[head], self.starts[~head] = offs[:-1], breaks + 1
        self.ends[tail], self.ends[~tail] = offs[1:], breaks
        self.hash = span_hash(lambda a, b: _byte_values(False)[data[a:b]], _bytes)(self.starts, self.ends)


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Filter:
    """A bit for each hash prefix: most keys that are not in a table drop out before the search."""

    def __init__(self, table: np.ndarray):
        bits = min(28, max(18, int(len(table)).bit_length() + 5))
        self.table, self.shift = table, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[table >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among keys of those in the table, and their places there."""
        maybe = np.flatnonzero(self.seen[keys >> self.shift])
        at = lookup(self.table, keys[maybe])
        return maybe[at >= 0], at[at >= 0]
