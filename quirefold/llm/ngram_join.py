"""N-gram Jaccard self-join by MinHash banding, and its near-duplicate groups.

A document's set holds its distinct runs of five lower-cased words (all words of a shorter
text).  Two documents are *linked* if the Jaccard similarity of their sets is 0.8 or more.

1. Documents of equal sets make a *class* (copies are never compared).
2. Each class has a MinHash signature, cut into bands.  The numbers of bands and rows are
   the cheapest that find a pair at the threshold with the target recall.
3. Classes are shuffled on band hashes.  In a band's bucket each class is tied to the
   bucket's smallest class: a star, not all pairs; stars that touch make a *candidate group*.
4. Links are verified on the full n-gram sets, inside candidate groups.  A group of more
   than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a task of its own,
   so no task holds a large group; all pairs of a group are counted, none is written out.
5. The verified links' components are the groups of near duplicates.

The candidate group holds every pair that shares a band, so verification sees at least all
banded pairs; recall is that of the bands or better.

Sums and minima by group are written to the shared folder before they are joined back, so
that both sides of such a join are plain shuffles and a hot group's partition can be split.

Result, one row for each document: ``class_id`` (smallest doc_id of its group), ``text_id``
(smallest doc_id of the same set), ``n_copies`` (documents of the same set, itself
included), ``n_links`` (other documents linked to it: copies and similar ones) and
``n_linked_texts`` (different sets linked to its own).

Defined results: null and wordless texts are linked to nothing (class_id and text_id are
their own id); repeated rows are copies; null ids count in groups but name none (a group of
null ids alone has a null class_id); rows of null id and equal text share one key, of which a task
reads one; further columns are ignored, whatever their names.  Classes are known
by a 64-bit hash of their set, together with a second one where they are made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .shared import dropped, fresh, map_batches, stored

GRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
BLOCK = 128


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): of the choices that reach the recall with `most` hashes, that of the most rows (fewest false pairs)."""
    found = (1, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def sets(data: np.ndarray, offs: np.ndarray):
    """The sorted distinct n-gram hashes of each text of a block."""
    w = T.Words(data, offs, T.ALNUM, True)
    at, h = w.windows(GRAM)
    short = np.flatnonzero((w.counts > 0) & (w.counts < GRAM))
    whole = w.runs(w.first[short], w.first[short + 1]) if len(short) else np.empty(0, np.uint64)
    edge = np.searchsorted(at, w.first)
    out = [np.unique(h[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
    for r, x in zip(short.tolist(), whole, strict=True):
        out[r] = np.array([x], np.uint64)
    return out


class _Sign:
    """doc_id, row_key, set (two hashes), n, bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows

    def __call__(self, batches):
        n = self.bands * self.rows
        factor = T.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                own = sets(data, offs)
                size = np.array([len(x) for x in own], np.int64)
                full = np.flatnonzero(size)
                first = np.cumsum(size[full]) - size[full]
                band = np.zeros((r1 - r0, self.bands), np.uint64)
                keys = np.zeros((2, r1 - r0), np.uint64)
                if len(full):
                    flat = np.concatenate([own[i] for i in full])
                    keys[0, full] = T.mix(np.add.reduceat(T.mix(flat + np.uint64(1)), first))
                    keys[1, full] = np.bitwise_xor.reduceat(T.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
                    for k in range(self.bands):
                        h = np.full(len(full), k + 1, np.uint64)
                        for f in factor[k * self.rows : (k + 1) * self.rows]:
                            h = T.mix(h ^ np.minimum.reduceat(flat * f, first))
                        band[full, k] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(r1 - r0 + 1, dtype=np.int32) * self.bands), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], T.column(b, "row_key")[r0:r1], pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(size), lists], ["doc_id", "row_key", "cls", "cls2", "n", "bands"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node that it is connected with.

    Each round ties both ends of an edge to the smallest neighbour; stars are what does not change.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        tied = both.join(least, "u").select("v", "m")
        new = tied.unionByName(least.select(F.col("u").alias("v"), "m")).where("v <> m")
        old, edges = edges, stored(new.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct(), "edges")
        dropped(old, least)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())


class _Sets:
    """A class's set once a task, however many rows share the key of its row (null ids do)."""

    def __call__(self, batches):
        seen: set[int] = set()
        for b in batches:
            new = [i for i, c in enumerate(T.column(b, "cls").to_pylist()) if c not in seen and not seen.add(c)]
            b = b if len(new) == len(b) else b.take(pa.array(new, pa.int64()))
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                own = pa.array([x.tobytes() for x in sets(data, offs)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(T.column(b, n)[r0:r1] for n in ("cls", "root", "blocks", "copies")), own], ["cls", "root", "blocks", "copies", "grams"])


class _Verify:
    """(u, v, links, texts) for each class of a pair of blocks: tied to v, the smallest class that its links here lead to."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches):
        key, rows = None, []
        for b in batches:
            for row in zip(*(T.column(b, n).to_pylist() for n in ("root", "i", "j", "own", "cls", "copies", "grams")), strict=True):
                if row[:3] != key:
                    yield from self.group(rows)
                    key, rows = row[:3], []
                rows.append(row)
        yield from self.group(rows)

    def group(self, rows):
        distinct = {r[4]: r for r in rows}  # repeated rows of the input come as often as they are
        rows = [distinct[c] for c in sorted(distinct)]
        m = len(rows)
        if m < 2:
            return
        grams = [np.frombuffer(r[6], np.uint64) for r in rows]
        size = np.array([len(g) for g in grams], np.int64)
        common = shared_counts(grams)
        linked = common >= self.threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        side = np.array([r[3] for r in rows])
        if rows[0][1] != rows[0][2]:
            linked &= side[:, None] != side[None, :]
        copies = np.array([r[5] for r in rows], np.int64)
        links, texts = linked @ copies, linked.sum(1)
        root = np.arange(m)
        while True:  # labels spread to the smallest neighbour's until nothing changes
            new = np.where(linked, root[None, :], m).min(1, initial=m)
            new = np.minimum(new, root)
            if (new == root).all():
                break
            root = new
        own = np.flatnonzero(texts)
        cls = np.array([r[4] for r in rows], np.int64)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(cls[root[own]]), pa.array(links[own].astype(np.int64)), pa.array(texts[own].astype(np.int64))], ["u", "v", "links", "texts"])


def shared_counts(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; grams that the same sets have are counted at once."""
    m = len(grams)
    owner = np.repeat(np.arange(m), [len(g) for g in grams])
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.ones(len(flat), bool)
    head[1:] = flat[1:] != flat[:-1]
    first = np.flatnonzero(head)
    mark = T.mix(np.arange(1, m + 1, dtype=np.uint64))
    pattern = np.add.reduceat(mark[owner], first)  # stands for the set of sets that have the gram
    many = np.diff(np.append(first, len(flat))) > 1
    _, pick, which, weight = np.unique(pattern[many], return_index=True, return_inverse=True, return_counts=True)
    out = np.zeros((m, m))
    column = np.full(len(first), -1)
    column[np.flatnonzero(many)[pick]] = np.arange(len(pick))
    at = column[np.cumsum(head) - 1]
    cells = np.flatnonzero(at >= 0)
    row, col = owner[cells], at[cells]
    step = 4096
    for a in range(0, len(pick), step):
        here = (col >= a) & (col < a + step)
        x = np.zeros((m, min(step, len(pick) - a)), np.float32)
        x[row[here], col[here] - a] = 1
        out += (x * weight[a : a + step].astype(np.float32)) @ x.T
    out[np.arange(m), np.arange(m)] = [len(g) for g in grams]
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id, text_id, n_copies, n_links, n_linked_texts, n_grams, and keys of group and row."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    signed = stored(map_batches(docs, _Sign(bands, rows), "doc_id long, row_key long, cls long, cls2 long, n long, bands array<long>"), "signatures")
    found = signed.where("n > 0")
    classes = stored(found.groupBy("cls", "cls2").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cls", F.explode("bands").alias("band"))
    leaders = stored(banded.groupBy("band").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "leaders")
    stars = banded.join(leaders, "band").where("cls <> lead").select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    groups = stored(components(stars), "groups")
    dropped(leaders)
    # verification: a class is read once, by the key of one of its rows
    sizes = stored(groups.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = groups.join(sizes, "root").join(classes.select(F.col("cls").alias("node"), "row_key", "copies"), "node")
    members = members.select("row_key", F.col("node").alias("cls"), "root", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"), "copies")
    gram_sets = map_batches(docs.select("row_key", "text").join(members, "row_key").select("cls", "root", "blocks", "copies", "text"), _Sets(), "cls long, root long, blocks long, copies long, grams binary")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    spread = gram_sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = spread.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "copies", "grams")
    keyed = keyed.repartition(max(parallel, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = stored(map_batches(keyed, _Verify(threshold), "u long, v long, links long, texts long"), "links")
    dropped(groups, sizes)
    counts = links.groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = stored(components(links.select("u", "v")), "roots")
    known = stored(classes.select("cls", "text_id", "copies").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(counts, "cls", "left"), "known")
    dropped(classes, links, roots)
    least = stored(known.where("root is not null").groupBy("root").agg(F.min("text_id").alias("group_id")), "least")
    known = known.join(least, "root", "left").select("cls", "text_id", "copies", F.coalesce("group_id", "text_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("root", "cls").alias("group_key"))
    out = signed.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(known, "cls", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.col("n").alias("n_grams"),
        "group_key",
        "row_key",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each group: the row of the smallest id (of equal rows, one; wordless ones all stay)."""
    found = near_duplicates(docs, doc_id, text)
    first = found.where("n_grams > 0").groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("row"))
    key, one, nth = fresh(docs.columns, "row_key", "one", "nth")
    stay = first.select(F.col("row.row_key").alias(key), F.lit(True).alias(one)).unionByName(found.where("n_grams = 0").select(F.col("row_key").alias(key), F.lit(False).alias(one)).distinct())
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))  # rows of one key are equal in id and text
    return keyed.join(stay, key).withColumn(nth, rank).where(~F.col(one) | (F.col(nth) == 1)).select(*docs.columns)
