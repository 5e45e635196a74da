"""Substring dedup by seed and extend.

A *window* is ``WINDOW`` (20) consecutive words of a document.  A word goes if a window that
covers it also starts earlier: in a document of smaller id, or earlier in the same one.

* Seeds: of the 8-word grams of a window the one of the smallest hash is its *anchor*
  (winnowing).  Equal windows have equal anchors, and neighbouring windows mostly share
  theirs, so there is about one anchor for seven words.
* Join: anchors that occur once in the corpus are dropped.  This join is on 64-bit anchors.
* Extend: an anchor that occurs again sends its *stretch*, the words of all windows that it
  anchors, up to 12 to the left and to the right of it.  Occurrences of an anchor meet, and each is matched
  both ways, word by word, with the earliest occurrence that it shares a window with.
* Keep: runs of windows that have an earlier twin are the maximal repeats; shorter ones than
  20 words never make a window.  ``passages`` returns them as spans.

Windows are grouped by a 64-bit hash and then compared by the hashes of their 20 words, one
by one; a group that holds different words is parted by them.

Texts are packed into *units* (a few MB of rows each, compressed) in a stored table.  Both
joins move packed arrays: a unit sends each bucket of the hash space one row with its
distinct anchors or stretches, and gets one bit for each anchor or window back.  Whatever occurs many times in
a unit is sent once, so a passage that a third of all documents share makes one entry a
unit, and no pair of documents is ever written out.  Rows are at most as many as anchors.  A task takes whole
buckets in order of the hash space and holds one at a time; units and buckets grow with the input between
fixed bounds, which bounds the memory of a task.

Defined results: a null text has no words; a null id comes behind all others; rows of equal
id are the same document to the order, so equal windows at equal starts in them all stay;
further columns are ignored, and ``remove_repeats`` passes them on and gives its counts
other names where theirs are taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textscan as T
from .shared import fresh, from_ipc, map_batches, stored, to_ipc

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1  # windows around one place of an anchor
UNIT_BYTES = (1 << 20, 1 << 25)  # least and most bytes of text in a unit (a longer text alone)
BUCKET_BYTES = (1 << 23, 1 << 26)  # of text for one bucket
MOST_PARTITIONS = 20_000
_NO_ID = np.iinfo(np.int64).max
REPLY = "unit long, bucket int, bits binary"
ASK = "bucket int, unit long, payload binary"


class _Pack:
    """Rows of a partition as units: (unit, n_bytes, blob)."""

    def __init__(self, text: str, unit_bytes: int):
        self.text, self.unit_bytes = text, unit_bytes

    def __call__(self, batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for r0, r1, data, _ in T.blocks(T.column(b, self.text), self.unit_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([len(data)], pa.int64()), pa.array([to_ipc(b.slice(r0, r1 - r0))], pa.binary())], ["unit", "n_bytes", "blob"])
                k += 1


class Unit:
    """Windows and anchors of a unit."""

    def __init__(self, batch: pa.RecordBatch, id_: str, text: str):
        self.batch = batch
        texts = T.column(batch, text)
        ((_, _, data, offs),) = T.blocks(texts, 1 << 62) if len(batch) else ((0, 0, np.empty(0, np.uint8), np.zeros(1, np.int64)),)
        self.words = w = T.Words(data, offs, T.NONBLANK, False)
        ids = T.column(batch, id_).cast(pa.int64())
        self.ids = ids.fill_null(_NO_ID).to_numpy()
        n = len(w) - WINDOW + 1
        self.at = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1 :]) if n > 0 else np.empty(0, np.int64)
        grams = T.prefix_hash(w.hash, T._words)(np.arange(max(0, len(w) - GRAM + 1)), np.arange(GRAM, len(w) + 1)) if len(w) >= GRAM else np.empty(0, np.uint64)
        if len(self.at):
            least, have = grams, 1
            while 2 * have <= SPAN:  # sliding minima of 2, 4, 8, ... grams
                least, have = np.minimum(least[: len(least) - have], least[have:]), 2 * have
            self.anchor = T.mix(np.minimum(least[self.at], least[self.at + SPAN - have]))  # minima crowd at 0; mixed they are even
            self.anchors = np.unique(self.anchor)
            del least
            grams.sort()
            twice = np.unique(T.mix(grams[1:][grams[1:] == grams[:-1]]))
            self.own_again = T.lookup(twice, self.anchors) >= 0
        else:
            self.anchor = self.anchors = np.empty(0, np.uint64)
            self.own_again = np.empty(0, bool)

    def candidates(self, again: np.ndarray) -> None:
        """Extend the anchors that occur again: their stretches, and which of them come first in this unit."""
        w, at = self.words, self.at
        new = np.ones(len(at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        pieces = -(-np.diff(np.append(first, len(at))) // SPAN)  # a text that repeats itself may keep an anchor for long
        first = np.repeat(first, pieces) + SPAN * _ramp(pieces)
        many = np.diff(np.append(first, len(at)))
        if len(first):
            pick = again[np.searchsorted(self.anchors, self.anchor[first])]
            first, many = first[pick], many[pick]
        word, anchor = at[first], self.anchor[first]
        row = w.row[word]
        doc, start = self.ids[row], word - w.first[row]
        key = w.runs(word, word + many + WINDOW - 1)
        order = np.lexsort((start, doc, many, key, anchor))
        anchor, key, doc, start, many, first = (x[order] for x in (anchor, key, doc, start, many, first))
        head = np.ones(len(key), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (many[1:] != many[:-1])
        heads = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        self.keys, self.doc, self.start, self.many, self.word = anchor[heads], doc[heads], start[heads], many[heads], at[first[heads]]
        later = (doc != self.doc[group]) | (start != self.start[group])
        begin = np.cumsum(self.many) - self.many
        self.window = at[np.repeat(first, many) + _ramp(many)]  # first words of all candidate windows
        self.asked = np.repeat(begin[group], many) + _ramp(many)  # and the places of their answers
        self.later = np.repeat(later, many)

    def stretch_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of the distinct stretches, a blank behind each word; and each stretch's edge in them."""
        w, size = self.words, self.many + WINDOW - 1
        width = w.ends - w.starts + 1
        total = np.concatenate(([0], np.cumsum(width)))
        edges = np.concatenate(([0], np.cumsum(total[self.word + size] - total[self.word])))
        out = np.empty(int(edges[-1]), np.uint8)
        for i in range(0, len(size), 8192):
            words = np.repeat(self.word[i : i + 8192], size[i : i + 8192]) + _ramp(size[i : i + 8192])
            n = width[words]
            end = np.cumsum(n)
            place = np.arange(int(end[-1]), dtype=np.int32) + np.repeat((w.starts[words] - (end - n)).astype(np.int32), n)
            own = w.data[np.minimum(place, len(w.data) - 1)]
            own[end - 1] = 0x20
            out[edges[i] : edges[i] + len(own)] = own
        return out, edges

    def removed(self, earlier_elsewhere: np.ndarray) -> np.ndarray:
        """For each word, whether a window with an earlier twin covers it."""
        gone = self.later | earlier_elsewhere[self.asked]
        return self.words.covered(self.window[gone], WINDOW)


def _ramp(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of many."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys (a bucket is a range of the hash space)."""
    bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(sorted_keys, bounds), len(sorted_keys))


def _asks(unit: int, edges: np.ndarray, payload):
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        rows = [payload(int(edges[i]), int(edges[i + 1])) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), unit)), pa.array(rows, pa.binary())], ["bucket", "unit", "payload"])


def _bits(replies, edges: np.ndarray) -> np.ndarray:
    """The replies of all buckets, put together in the order of the unit's keys."""
    out = np.zeros(int(edges[-1]), bool)
    for r in replies or ():
        a, z = int(edges[r["bucket"]]), int(edges[r["bucket"] + 1])
        out[a:z] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=z - a)
    return out


class _Job:
    def __init__(self, id_, text, buckets):
        self.id, self.text, self.buckets = id_, text, buckets

    def units(self, batches):
        for b in batches:
            for i in range(len(b)):
                yield T.column(b, "unit")[i].as_py(), Unit(from_ipc(T.column(b, "blob")[i].as_buffer()), self.id, self.text), {n: T.column(b, n)[i].as_py() for n in b.schema.names if n.startswith("replies")}

    def resolved(self, unit: Unit, replies) -> None:
        again = unit.own_again | _bits(replies, _bucket_edges(unit.anchors, self.buckets))
        unit.candidates(again)


class _AskAnchors(_Job):
    def __call__(self, batches):
        for k, unit, _ in self.units(batches):
            x = unit.anchors
            yield from _asks(k, _bucket_edges(x, self.buckets), lambda a, z, x=x: x[a:z].tobytes())


class _AskWindows(_Job):
    def __call__(self, batches):
        for k, x, got in self.units(batches):
            self.resolved(x, got["replies1"])
            flat, edges = x.stretch_bytes()
            sizes = np.diff(edges).astype(np.uint32)

            def payload(a, z, x=x, flat=flat, edges=edges, sizes=sizes):
                parts = (x.doc[a:z], x.start[a:z], sizes[a:z], x.many[a:z].astype(np.uint8), flat[edges[a] : edges[z]])
                raw = b"".join(p.tobytes() for p in parts)
                return np.array([z - a, len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)

            yield from _asks(k, _bucket_edges(x.keys, self.buckets), payload)


def _stretches(payload: bytes):
    """(doc, start, sizes in bytes, windows, words) of a unit's stretches."""
    n, size = np.frombuffer(payload, np.int64, 2).tolist()
    raw = np.frombuffer(pa.decompress(payload[16:], size, "zstd", asbytes=True), np.uint8)
    return raw[: 8 * n].view(np.int64), raw[8 * n : 16 * n].view(np.int64), raw[16 * n : 20 * n].view(np.uint32), raw[20 * n : 21 * n], raw[21 * n :]


def _by_bucket(batches):
    """(bucket, units, payloads) from rows in order of buckets."""
    now, units, payloads = None, [], []
    for b in batches:
        for bucket, unit, payload in zip(*(T.column(b, n).to_pylist() for n in ("bucket", "unit", "payload")), strict=True):
            if bucket != now:
                if units:
                    yield now, units, payloads
                now, units, payloads = bucket, [], []
            units.append(unit)
            payloads.append(payload)
    if units:
        yield now, units, payloads


def _replies(bucket, units, flags, sizes):
    ends = np.cumsum(sizes)
    rows = [np.packbits(flags[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array([bucket] * len(units), pa.int32()), pa.array(rows, pa.binary())], ["unit", "bucket", "bits"])


def _answer_anchors(batches):
    """Does the anchor occur in another unit?"""
    for bucket, units, payloads in _by_bucket(batches):
        sizes = [len(p) // 8 for p in payloads]
        _, which, count = np.unique(np.frombuffer(b"".join(payloads), np.uint64), return_inverse=True, return_counts=True)
        yield _replies(bucket, units, count[which] > 1, sizes)


def _answer_windows(batches):
    """Does the window start earlier, somewhere?  Answered for each window of each stretch."""
    for bucket, units, payloads in _by_bucket(batches):
        keys, words, at, doc, start, sizes, base = [], [], [], [], [], [], 0
        for p in payloads:
            d, s, size, many, data = _stretches(p)
            w = T.Words(data, np.concatenate(([0], np.cumsum(size, dtype=np.int64))), T.NONBLANK, False)
            place, key = w.windows(WINDOW)
            keys.append(key)
            words.append(w.hash)
            at.append(place + base)
            doc.append(np.repeat(d, many))
            start.append(np.repeat(s, many) + _ramp(many.astype(np.int64)))
            sizes.append(len(key))
            base += len(w)
        doc, start = np.concatenate(doc), np.concatenate(start)
        first = earliest(np.concatenate(keys), doc, start, np.concatenate(at), np.concatenate(words))
        yield _replies(bucket, units, (doc != doc[first]) | (start != start[first]), sizes)


def earliest(key, doc, start, at, words) -> np.ndarray:
    """For each window the earliest one of the same words; key: hashes, at: where its words are in words."""
    first = earliest_of(key, doc, start)
    todo = np.flatnonzero(first != np.arange(len(key)))
    same = np.ones(len(todo), bool)
    for j in range(WINDOW):  # all words, one place after the other
        same &= words[at[todo] + j] == words[at[first[todo]] + j]
    if not same.all():  # windows of different words have one hash: part them by their words
        odd = np.flatnonzero(np.isin(first, np.unique(first[todo[~same]])))
        _, which = np.unique(words[at[odd][:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)
        first[odd] = odd[earliest_of(which.ravel(), doc[odd], start[odd])]
    return first


def earliest_of(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    order = np.lexsort((start, doc, group))
    head = np.ones(len(order), bool)
    head[1:] = group[order][1:] != group[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


class _Digest(_Job):
    """doc_id, n_words, n_removed, kept_sha256."""

    def __call__(self, batches):
        for _, unit, got in self.units(batches):
            gone, w = _gone(self, unit, got), unit.words
            kept, first = np.flatnonzero(~gone), w.first
            spans = np.searchsorted(kept, first)
            digest = [hashlib.sha256(_words(w, kept[a:z])).hexdigest() for a, z in zip(spans[:-1], spans[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([T.column(unit.batch, self.id).cast(pa.int64()), pa.array(w.counts), pa.array(w.by_row(gone)), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


class _Passages(_Job):
    """doc_id, first_word, n_words: the maximal repeats."""

    def __call__(self, batches):
        for _, unit, got in self.units(batches):
            gone, w = _gone(self, unit, got).astype(np.int8), unit.words
            edge = np.diff(np.concatenate(([0], gone, [0])))
            edge[1:-1][(w.row[1:] != w.row[:-1]) & (gone[1:] & gone[:-1]).astype(bool)] = 2  # one ends, the next begins
            begin, end = np.flatnonzero(edge > 0), np.flatnonzero((edge < 0) | (edge == 2))
            row = w.row[begin]
            yield pa.RecordBatch.from_arrays([T.column(unit.batch, self.id).cast(pa.int64()).take(pa.array(row)), pa.array(begin - w.first[row]), pa.array(end - begin)], ["doc_id", "first_word", "n_words"])


class _Rewrite(_Job):
    """All columns, the text without its removed words, and two counts; rows that lose all their words go."""

    def __init__(self, id_, text, buckets, names):
        super().__init__(id_, text, buckets)
        self.names = names

    def __call__(self, batches):
        for _, unit, got in self.units(batches):
            gone, w, b = _gone(self, unit, got), unit.words, unit.batch
            n_removed = w.by_row(gone)
            texts = T.column(b, self.text).to_pylist()
            for r in np.flatnonzero(n_removed).tolist():
                texts[r] = _without(w, r, gone)
            at = b.schema.names.index(self.text)
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(w.counts), pa.array(n_removed)], [*b.schema.names, *self.names])
            yield out.filter(pa.array((n_removed == 0) | (n_removed < w.counts)))


def _gone(job: _Job, unit: Unit, got) -> np.ndarray:
    job.resolved(unit, got["replies1"])
    windows = np.concatenate(([0], np.cumsum(unit.many)))
    return unit.removed(_bits(got["replies2"], windows[_bucket_edges(unit.keys, job.buckets)]))


def _words(w: T.Words, which: np.ndarray) -> bytes:
    """Words joined by single blanks: runs that are so joined in the text are taken at once."""
    if not len(which):
        return b""
    data, out = w.data, []
    follows = (np.diff(which) == 1) & (w.starts[which[1:]] - w.ends[which[:-1]] == 1)
    follows &= data[w.ends[which[:-1]]] == 0x20
    edge = np.flatnonzero(~follows) + 1
    for a, z in zip(np.append(0, edge).tolist(), np.append(edge, len(which)).tolist(), strict=True):
        out.append(data[w.starts[which[a]] : w.ends[which[z - 1]]].tobytes())
    return b" ".join(out)


def _without(w: T.Words, row: int, gone: np.ndarray) -> str:
    """A text without its removed words and the blanks behind each of them."""
    a, z = int(w.first[row]), int(w.first[row + 1])
    lo, hi = int(w.offs[row]), int(w.offs[row + 1])
    out, at = [], lo
    drop = gone[a:z]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(w.data[at : w.starts[a + s]].tobytes())
        at = int(w.starts[a + e]) if a + e < z else hi
    out.append(w.data[at:hi].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def _exchange(asks: DataFrame, answer, buckets: int, partitions: int) -> DataFrame:
    """Each partition takes as many buckets as any other, in order."""
    own = F.floor(F.col("bucket").cast("long") * partitions / buckets).cast("int")
    return map_batches(asks.repartitionById(partitions, own).sortWithinPartitions("bucket", "unit"), answer, REPLY)


def _with(units: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    grouped = replies.groupBy("unit").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))  # of one unit: bounded by it
    return units.join(grouped, "unit", "left")


def _resolve(docs: DataFrame, id_: str, text: str, last, schema) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    unit_bytes = min(UNIT_BYTES[1], max(UNIT_BYTES[0], size // 20_000))
    buckets = int(max(spark.sparkContext.defaultParallelism, size // min(BUCKET_BYTES[1], max(BUCKET_BYTES[0], size // 20_000))))
    partitions = min(buckets, MOST_PARTITIONS)
    units = stored(map_batches(docs, _Pack(text, unit_bytes), "unit long, n_bytes long, blob binary"), "units").select("unit", "blob")
    job = (id_, text, buckets)
    first = stored(_exchange(map_batches(units, _AskAnchors(*job), ASK), _answer_anchors, buckets, partitions), "anchors")
    again = _with(units, first, "replies1")
    second = stored(_exchange(map_batches(again, _AskWindows(*job), ASK), _answer_windows, buckets, partitions), "windows")
    return map_batches(_with(_with(units, first, "replies1"), second, "replies2"), last(*job), schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _resolve(docs, "doc_id", "text", _Digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each maximal repeat: doc_id, first_word (from 0), n_words (20 at least)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _resolve(docs, "doc_id", "text", _Passages, "doc_id long, first_word long, n_words long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without repeated passages; plus n_words (before) and n_removed, whose names get underscores behind them if they are taken."""
    names = fresh(docs.columns, "n_words", "n_removed")
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return _resolve(docs, doc_id, text, lambda *job: _Rewrite(*job, names), schema)
