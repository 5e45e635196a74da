"""Best-fit packing by length patterns and non-negative least squares.

Texts are tokenised (plus one end token); only those longer than a sequence are cut, into
full pieces, the first of which may be shorter.  Packing then works on the histogram of
piece lengths, which has ``size`` entries at most however many pieces there are:

1. *Patterns* are few lengths (1 to 3) that fill a sequence but for ``WASTE`` tokens.
2. Non-negative least squares fits how often each pattern is used to the histogram (by
   coordinate descent: a pattern touches few lengths).
3. The fit is rounded, never beyond the pieces there are.
4. The pieces that are left are packed best-fit, longest first, on their histogram: a
   sequence that is filled once is repeated as often as its lengths allow.

The plan (a few thousand entries) is broadcast.  A piece gets a rank among those of its
length, and the rank alone says in which sequence and where in it the piece lies.  Ranks
come from counts by (length, bucket), so a length that a third of all pieces have is
spread over many tasks.

Defined results: a null or empty text is one piece of the end token alone; equal rows are
pieces of their own; special strings in texts are read as the tokenizer library's default;
null ids are packed as others; an empty table gives no sequence; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretoken as P
from . import textscan as T
from .shared import hold, map_batches, stored

WASTE = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, Tokens] = {}


class Tokens:
    """Token ids of texts, piece by piece of the pre-tokenizer, each distinct piece encoded once."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.known = P.CodePoints(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most = most
        self.clear()

    def clear(self):
        self.memo = P.Memo(self.most)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _store(self, ids: list[int]) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(self.used // 2, len(ids)), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return (self.used - len(ids)) << 32 | len(ids)

    def _ids(self, words: list[str]):
        for i in range(0, len(words), 1024):
            for e in self.library.encode_batch_fast(words[i : i + 1024], add_special_tokens=False):
                yield e.ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges) of all texts, end to end."""
        odd = {}
        if any(s in t for s in self.specials for t in texts):
            odd = {i: np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if any(s in t for s in self.specials)}
            texts = ["" if i in odd else t for i, t in enumerate(texts)]
        points, marks = P.with_marks(texts)
        start, end = P.runs_with_spaces(points, self.known.kind)
        if self.memo.full or self.used > 4 * self.most:
            self.clear()
        if len(start):
            distinct, first, which = np.unique(P.piece_hashes(points, start, end), return_index=True, return_inverse=True)

            def compute(new):
                spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
                return [self._store(ids) for ids in self._ids([points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in spans])]

            value = self.memo.get(distinct, compute)
            size, place = (value & 0xFFFFFFFF)[which], (value >> 32)[which]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
            edges = total[np.searchsorted(start, marks)]
        else:
            ids, edges = np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if odd:
            parts = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            ids, edges = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, edges


class _Cut:
    def __init__(self, path, size, end_id):
        self.path, self.size, self.end_id = path, size, end_id

    def __call__(self, batches):
        if self.path not in _loaded:
            _loaded[self.path] = Tokens(self.path)
            hold("packing", _loaded.clear)
        tokens, size = _loaded[self.path], self.size
        for b in batches:
            for r0, r1, texts in P.text_lists(b):
                ids, edges = tokens.encode(texts)
                out = ([], [], [], [], [])
                for r, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    raw = np.append(ids[a:z], self.end_id).astype("<u4").tobytes()
                    n = z - a + 1
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for column, value in zip(out, (r, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])), strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1].take(pa.array(out[0], pa.int64())), *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True))], [c.split()[0] for c in PIECES.split(", ")])


def cut_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Cut(path, size, end_id), PIECES, "packing")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, ...]]:
    """1 to 3 lengths that fill a sequence but for WASTE: pairs, and triples with one of the most frequent lengths."""
    lengths = sorted(histogram)
    often = sorted(lengths, key=lambda n: (-histogram[n], n))[:12]
    found = set()

    def fill(*chosen):
        room = size - sum(chosen)
        i = bisect_right(lengths, room) - 1
        if room >= 0 and i >= 0 and room - lengths[i] <= WASTE:
            found.add(tuple(sorted((*chosen, lengths[i]), reverse=True)))

    for a in lengths:
        if size - a <= WASTE:
            found.add((a,))
        fill(a)
        for b in often:
            fill(a, b)
    return sorted(found, reverse=True)


def fit_counts(histogram: dict[int, int], found: list[tuple[int, ...]], sweeps: int = 40) -> list[float]:
    """x >= 0 that minimises the squared misfit of the patterns' lengths to the histogram."""
    left = {n: float(c) for n, c in histogram.items()}
    shapes = [[(n, p.count(n)) for n in sorted(set(p))] for p in found]
    norms = [sum(c * c for _, c in s) for s in shapes]
    x = [0.0] * len(found)
    for _ in range(sweeps):
        moved = 0.0
        for i, shape in enumerate(shapes):
            new = max(0.0, x[i] + sum(c * left[n] for n, c in shape) / norms[i])
            if change := new - x[i]:
                x[i] = new
                for n, c in shape:
                    left[n] -= c * change
                moved += abs(change)
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how many in a sequence)], repeats)]: every piece of the histogram exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    found = patterns(left, size)
    for p, x in sorted(zip(found, fit_counts(left, found), strict=True), key=lambda v: (-sum(v[0]), -v[1], v[0])):
        shape = [(n, p.count(n)) for n in sorted(set(p), reverse=True)]
        times = min([int(x), *(left.get(n, 0) // c for n, c in shape)])
        if times > 0:
            out.append((shape, times))
            for n, c in shape:
                left[n] -= c * times
    lengths = sorted(n for n, c in left.items() if c > 0)
    while lengths:
        room, shape = size, []
        i = len(lengths) - 1
        while i >= 0 and room >= lengths[0]:
            n = lengths[i]
            c = min(room // n, left[n])
            shape.append((n, c))
            room -= n * c
            i = min(i, bisect_right(lengths, room)) - 1
        times = min(left[n] // c for n, c in shape)
        out.append((shape, times))
        for n, c in shape:
            left[n] -= c * times
        lengths = [n for n in lengths if left[n] > 0]
    return out


class Slots:
    """For each length: from which rank on which plan entry holds its pieces."""

    def __init__(self, entries):
        by: dict[int, list] = {}
        sequence = 0
        for shape, times in entries:
            offset = 0
            for n, c in shape:
                by.setdefault(n, []).append((c * times, c, sequence, offset))
                offset += n * c
            sequence += times
        self.sequences = sequence
        self.by = {n: (np.concatenate(([0], np.cumsum([r[0] for r in rows])[:-1])), *(np.array(x) for x in list(zip(*rows, strict=True))[1:])) for n, rows in by.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            begin, per, first, base = self.by[int(n)]
            e = np.searchsorted(begin, rank[own], "right") - 1
            r = rank[own] - begin[e]
            sequence[own] = first[e] + r // per[e]
            offset[own] = base[e] + (r % per[e]) * n
        return sequence, offset


class _Place:
    def __init__(self, slots):
        self.slots = slots

    def __call__(self, batches):
        slots = self.slots.value
        for b in batches:
            sequence, offset = slots.place(T.column(b, "length").to_numpy(), T.column(b, "rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(T.column(b, c.split()[0]) for c in PIECES.split(", ")), pa.array(sequence), pa.array(offset)], [*(c.split()[0] for c in PIECES.split(", ")), "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, path, doc_id, text, size, end_id), "pieces")  # read twice, tokenised once
    buckets = max(1, docs.sparkSession.sparkContext.defaultParallelism * 4)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, size)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(base, ["length", "bucket"]).withColumn("rank", (F.col("base") + F.col("own") - 1).cast("long"))
    return map_batches(ranked.drop("bucket", "own", "base"), _Place(slots), PIECES + ", sequence_id long, offset long")
