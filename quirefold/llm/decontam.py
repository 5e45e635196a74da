"""Benchmark decontamination: a prefix-filtered containment join.

Every item of a benchmark is cut into *windows* of 13 consecutive words (a shorter
item is one window).  A document contains a window when all the window's words stand
consecutively in it.  The join works as a prefix filter does for containment 1:

1. The shingles of a window (runs of four words, or all words of a shorter one) are
   ordered by rarity over all windows of the benchmark, the rarest first, ties by hash.
2. A window whose every shingle must occur needs a prefix of one token only: its rarest
   shingle and that shingle's place in the window are indexed.
3. A document's shingles are looked up in the index.  A hit fixes where the window would
   start; the positional and length bounds (it starts in and ends in the document) drop
   the others.
4. What is left is verified word by word over the whole window.

The index is made on the driver and broadcast in *slices* of about ``slice_words`` benchmark
words (a longer item is a slice of its own), one at a time: a larger benchmark takes more passes over the documents, each
of which stores its hits and lets go of its slice, and hits are merged by row.

Defined results: a null or wordless text has no words and no hits; an item without words
or with a null id is ignored; equal items count as separate items; repeated rows give a
row each; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import fresh, map_batches, stored

WINDOW, SHINGLE = 13, 4
HITS = "row_key long, n_words long, item_id string, start long, length long"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowIndex:
    """Windows of a slice of the benchmark under their rarest shingle."""

    def __init__(self, items: pa.Table, window: int = WINDOW, shingle: int = SHINGLE):
        flat, begin, length, owner, base = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in items.combine_chunks().to_batches():
            for r0, r1, data, offs in T.blocks(batch.column("text")):
                w = T.Words(data, offs, T.ALNUM, True)
                size = np.minimum(window, w.counts)
                many = np.where(size > 0, w.counts - size + 1, 0)
                ramp = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                flat.append(w.hash)
                begin.append(base + np.repeat(w.first[:-1], many) + ramp)
                length.append(np.repeat(size, many))
                owner.append(np.repeat(np.arange(r0, r1), many))
                base += len(w)
        self.items = items.column("item_id").to_pylist()
        self.flat, self.window = np.concatenate(flat), window
        self.begin, self.owner = np.concatenate(begin).astype(np.int32), np.concatenate(owner).astype(np.int32)
        self.length = np.concatenate(length).astype(np.int8)
        self.tables = {}
        for q in np.unique(np.minimum(shingle, self.length)).tolist():
            own = np.flatnonzero(np.minimum(shingle, self.length) == q)
            at = np.arange(len(self.flat) - q + 1)
            grams = T.prefix_hash(self.flat, T._words)(at, at + q)
            _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
            rarity = count[inverse]
            place = np.zeros(len(own), np.int32)
            key, rare = grams[self.begin[own]], rarity[self.begin[own]]
            for o in range(1, window - q + 1):  # the rarest, then the smallest hash, then the first place
                now = np.minimum(self.begin[own] + o, len(grams) - 1)
                better = (o <= self.length[own] - q) & ((rarity[now] < rare) | ((rarity[now] == rare) & (grams[now] < key)))
                place[better], key[better], rare[better] = o, grams[now][better], rarity[now][better]
            order = np.argsort(key, kind="stable")
            table, first = np.unique(key[order], return_index=True)
            self.tables[q] = (T.Filter(table), np.append(first, len(own)).astype(np.int32), own[order].astype(np.int32), place[order])

    def hits(self, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every verified occurrence in a block."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for q, (table, begin, owner, offset) in self.tables.items():
            at, h = w.windows(q)
            where, slot = table.find(h)
            many = begin[slot + 1] - begin[slot]
            pick = np.repeat(begin[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            win, start = owner[pick], np.repeat(at[where], many) - offset[pick]
            end, row = start + self.length[win], np.repeat(w.row[at[where]], many)
            ok = (start >= w.first[row]) & (end <= w.first[row + 1])
            win, start = win[ok], start[ok]
            for o in range(self.window):  # all words, one place after the other
                i = np.minimum(start + o, len(w) - 1)
                want = self.flat[np.minimum(self.begin[win] + o, len(self.flat) - 1)]
                same = (self.length[win] <= o) | (w.hash[i] == want)
                win, start = win[same], start[same]
            found.append((win, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _item_slices(items: DataFrame, slice_words: int):
    """Arrow tables of items, each of a bounded number of words (a longer item alone)."""
    sized = items.withColumn("_n", F.length("text").cast("long"))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    parts = int(total * 2 // slice_words + 1)  # a word and its blank take two characters at least
    if parts == 1:
        yield sized.drop("_n").toArrow()
        return
    for part in range(parts):
        yield sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).drop("_n").toArrow()


def benchmark_items(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct (item, text); items without id or text are ignored."""
    return bench.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = 2_000_000) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    out = DIGEST + ", item_ids array<string>"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, indexes = docs.sparkSession, (WindowIndex(t) for t in _item_slices(benchmark_items(bench), slice_words))
    first = next(indexes)
    more = next(indexes, None)
    if more is None:
        return map_batches(docs, _Digest(spark.sparkContext.broadcast(first)), out)
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    hits, index = None, first
    rest = _chain(more, indexes)
    del first, more
    while index is not None:
        held = spark.sparkContext.broadcast(index)
        part = stored(map_batches(docs, _Hits(held), HITS), "benchmark-hits")
        held.destroy()
        hits, index = part if hits is None else hits.unionByName(part), next(rest, None)
    words = hits.select("row_key", "item_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word"))
    merged = words.groupBy("row_key").agg(F.count_distinct("word").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    counted = map_batches(docs, _count_words, "doc_id long, row_key long, n_words long")
    none = F.array().cast("array<string>")
    return (
        counted.join(merged, "row_key", "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", none)})
        .select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids")
    )


def keep_clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = 2_000_000) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    slices = _item_slices(benchmark_items(bench), slice_words)
    first = next(slices)
    if next(slices, None) is None:
        return map_batches(docs, _Clean(docs.sparkSession.sparkContext.broadcast(WindowIndex(first)), text), docs.schema)
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    (own,) = fresh(docs.columns, "row_key")
    found = contamination(docs.select(key.alias("doc_id"), F.col(text).alias("text")), bench, slice_words=slice_words).where("contaminated").select(F.col("doc_id").alias(own)).distinct()
    return docs.withColumn(own, key).join(found, own, "left_anti").select(*docs.columns)


def _chain(head, tail):
    yield head
    yield from tail


def _count_words(batches):
    for b in batches:
        for r0, r1, data, offs in T.blocks(T.column(b, "text")):
            w = T.Words(data, offs, T.ALNUM, True, hashes=False)
            yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], T.column(b, "row_key")[r0:r1], pa.array(w.counts)], ["doc_id", "row_key", "n_words"])


class _Hits:
    def __init__(self, index):
        self.index = index

    def __call__(self, batches):
        index = self.index.value
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                w = T.Words(data, offs, T.ALNUM, True)
                win, start = index.hits(w)
                row = w.row[start]
                keys = T.column(b, "row_key")[r0:r1].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(w.counts[row]), pa.array([index.items[i] for i in index.owner[win]], pa.string()), pa.array(start - w.first[row]), pa.array(index.length[win].astype(np.int64))], ["row_key", "n_words", "item_id", "start", "length"])


def _hit_counts(index: WindowIndex, w: T.Words):
    win, start = index.hits(w)
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + index.length[win], -1)
    return win, start, w.by_row(np.cumsum(edge[:-1]) > 0)


class _Clean:
    def __init__(self, index, text):
        self.index, self.text = index, text

    def __call__(self, batches):
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, self.text)):
                w = T.Words(data, offs, T.ALNUM, True)
                *_, n_hit = _hit_counts(self.index.value, w)
                yield b.slice(r0, r1 - r0).filter(pa.array((n_hit == 0) | (20 * n_hit < w.counts)))


class _Digest:
    def __init__(self, index):
        self.index = index

    def __call__(self, batches):
        index, empty = self.index.value, hashlib.sha256(b"").hexdigest()
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                w = T.Words(data, offs, T.ALNUM, True)
                win, start, n_hit = _hit_counts(index, w)
                items = [[] for _ in range(r1 - r0)]
                for r, i in set(zip(w.row[start].tolist(), index.owner[win].tolist(), strict=True)):
                    items[r].append(index.items[i])
                items = [sorted(set(x)) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [T.column(b, "doc_id")[r0:r1], pa.array(w.counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else empty for x in items]), pa.array((n_hit > 0) & (20 * n_hit >= w.counts)), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
                )
