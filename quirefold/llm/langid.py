"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and runs of other than letters become one blank.  Four-character
grams (UTF-16 units, packed into 64 bits) are counted for each language over *all*
training rows, on the executors, and all of them are kept.  A model of more than ``slice_grams``
grams is made and broadcast in slices by a gram's last character but one: a gram, its
shorter grams and its contexts share it, so each slice is exact by itself.  Documents are
then read once for each slice.  Kneser-Ney discounts the counts of full grams and
the continuation counts of shorter ones, and interpolates down to a uniform floor.

Models lie in sorted hash arrays: one for each order, with the grams of all languages and
a column of log probabilities for each.  A text's grams are looked up from the longest
order down; a gram that no language has seen costs each language its back-off weight.
The language of the lowest cross-entropy per character wins, ties go to the first name.

Rejection is calibrated: one training row of ``calibration_part`` is kept out of a first
model, and is counted for the model that predicts; a prediction is ``rejected`` if its cross-entropy is more than ``reject_sd``
standard deviations above its language's mean there.  ``score`` is the winner's share when
cross-entropies are turned into odds over ``ODDS_CHARS`` characters.

Defined results: null or letterless texts are 'und' with score 0; rows with a null language
or null text teach nothing (an empty language is a language); a language of fewer than five
calibration rows rejects nothing; if nothing can be learned all are 'und'; repeated rows teach
and are predicted as often as they are; null ids are ids; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import map_batches, stored

ORDER = 4
ODDS_CHARS = 20
DISCOUNT = 0.75
_BLANK = 0x20
_letter: list = []


def _letters() -> np.ndarray:
    """Each UTF-16 unit as it is, or a blank where it is no letter (surrogates stand for letters)."""
    if not _letter:
        lut = np.full(1 << 16, _BLANK, np.uint16)
        for c in range(1 << 16):
            if unicodedata.category(chr(c))[0] in "LM" or 0xD800 <= c < 0xE000:
                lut[c] = c
        _letter.append(lut)
    return _letter[0]


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): a packed gram ending at each character of each text, and each text's first key.

    A text is led in by ORDER - 1 blanks, so every character is predicted by as many before it.
    """
    joined = "".join(f"\n\n\n{t}\n" for t in texts).lower() if texts else ""
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
    sizes = np.array([len(t.lower().encode("utf-16-le", "surrogatepass")) // 2 + 4 for t in texts], np.int64)
    edge = np.concatenate(([0], np.cumsum(sizes)))
    unit = _letters()[units]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(unit), bool)
    keep[1:] = (unit[1:] != _BLANK) | (unit[:-1] != _BLANK) | (row[1:] != row[:-1])
    unit, row = unit[keep].astype(np.uint64), row[keep]
    key = unit.copy()
    for back in range(1, ORDER):
        key[back:] |= unit[:-back] << np.uint64(16 * back)
        own = row[back:] == row[:-back]
        key[back:][~own] = (key[back:][~own] & np.uint64((1 << 16 * back) - 1)) | np.uint64(_BLANK << 16 * back)
        key[:back] |= np.uint64(_BLANK << 16 * back)
    lead = np.ones(len(unit), bool)
    lead[1:] = row[1:] != row[:-1]  # the blank a text begins with is no event
    first = np.searchsorted(row[~lead], np.arange(len(texts) + 1))
    return key[~lead], first


class Model:
    """Sorted arrays of grams by order; log2 probabilities of each language in each row."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], ends: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """ends: characters and their continuation counts in the whole language, where counts are of a slice."""
        self.langs = sorted(counts)
        n = len(self.langs)
        size = max((len(np.unique(k & np.uint64(0xFFFF))) for k, _ in (ends or counts).values()), default=1)
        floor = 1.0 / (size + 1)
        probs = [self._probabilities(*counts[x], floor, ends and ends[x]) for x in self.langs]
        self.orders = []
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[order][0] for p in probs])) if n else np.empty(0, np.uint64)
            table = np.empty((len(keys), n), np.float32)
            for j, p in enumerate(probs):
                table[:, j] = np.log2(self._score(p, keys, order))
            self.orders.append(keys)
            setattr(self, f"table{order}", table)
        # what a language pays where no language has seen the gram: its mean back-off to the next order
        self.floor = np.log2(np.array([floor * p["floor"] for p in probs], np.float32)) if n else np.empty(0, np.float32)
        self.context = []
        for order in range(2, ORDER + 1):
            keys = np.unique(np.concatenate([p[order][2] for p in probs])) if n else np.empty(0, np.uint64)
            weight = np.zeros((len(keys), n), np.float32)
            for j, p in enumerate(probs):
                at = T.lookup(p[order][2], keys)
                weight[at >= 0, j] = np.log2(p[order][3][at[at >= 0]])
            self.context.append((keys, weight))
        self.mean, self.sd = np.zeros(n), np.full(n, np.inf)

    @staticmethod
    def _probabilities(keys: np.ndarray, count: np.ndarray, floor: float, ends: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
        """Of each order: grams, their discounted mass, contexts, their back-off weights."""
        out = {}
        order = np.argsort(keys)
        keys, count = keys[order], count[order].astype(float)
        for k in range(ORDER, 0, -1):
            if k == 1 and ends is not None:
                keys, count = ends
            context = keys >> np.uint64(16) if k > 1 else np.zeros(len(keys), np.uint64)
            ctx, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, count, len(ctx))
            kinds = np.bincount(which, minlength=len(ctx))
            out[k] = (keys, (count - DISCOUNT) / total[which], ctx, DISCOUNT * kinds / total)
            if k > 1:  # continuation counts: in how many contexts does the shorter gram occur
                keys, count = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                count = count.astype(float)
        out["floor"] = float(out[1][3][0]) if len(out[1][3]) else 1.0
        out["uniform"] = floor
        return out

    @staticmethod
    def _score(p: dict, keys: np.ndarray, order: int) -> np.ndarray:
        """Interpolated probability of the last character of each gram given those before."""
        prob = np.full(len(keys), p["uniform"])
        for k in range(1, order + 1):
            gram = keys & np.uint64((1 << 16 * k) - 1) if k < 4 else keys
            seen, mass, ctx, weight = p[k]
            at = T.lookup(seen, gram)
            where = T.lookup(ctx, gram >> np.uint64(16)) if k > 1 else np.zeros(len(keys), np.int64) - (len(ctx) == 0)
            back = np.where(where >= 0, weight[np.maximum(where, 0)] if len(weight) else 1.0, 1.0)
            prob = back * prob + np.where(at >= 0, mass[np.maximum(at, 0)] if len(mass) else 0.0, 0.0)
        return prob

    def entropy(self, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits per character of each text in each language."""
        return self.bits(key, first) / np.maximum(np.diff(first), 1)[:, None]

    def bits(self, key: np.ndarray, first: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Bits of each text in each language, of the characters that own marks."""
        n = len(self.langs)
        bits = np.zeros((len(key), n), np.float32)
        todo = np.arange(len(key)) if own is None else np.flatnonzero(own)
        extra = np.zeros((len(todo), n), np.float32)
        for order in range(ORDER, 0, -1):
            gram = key[todo] & np.uint64((1 << 16 * order) - 1) if order < 4 else key[todo]
            at = T.lookup(self.orders[order - 1], gram)
            hit = at >= 0
            bits[todo[hit]] = getattr(self, f"table{order}")[at[hit]] + extra[hit]
            todo, gram, extra = todo[~hit], gram[~hit], extra[~hit]
            if order > 1 and len(todo):
                ctx, weight = self.context[order - 2]
                where = T.lookup(ctx, gram >> np.uint64(16))
                extra[where >= 0] += weight[where[where >= 0]]
        bits[todo] = self.floor + extra
        sums = np.zeros((len(key) + 1, n))
        np.cumsum(bits, axis=0, dtype=np.float64, out=sums[1:])
        return sums[first[:-1]] - sums[first[1:]]


def _slice(gram, parts: int):
    """The slice of a gram (array or column): by its last character but one."""
    if isinstance(gram, Column):
        unit = F.shiftrightunsigned(gram, 16).bitwiseAND(F.lit(0xFFFF).cast("long"))
        return F.shiftright((unit * 40503).bitwiseAND(F.lit(0xFFFF).cast("long")) * parts, 16)
    unit = ((gram >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
    return ((unit * 40503 & 0xFFFF) * parts) >> 16


class Sliced:
    """A model that is made slice by slice from stored counts."""

    def __init__(self, counts: DataFrame, parts: int):
        self.counts, self.parts = counts, parts
        pairs = counts.select("lang", F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pair")).distinct()
        ends = pairs.groupBy("lang", F.col("pair").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("gram")).agg(F.count("*").alias("n"))
        self.ends = self._collected(ends)
        self.langs = sorted(self.ends)
        self.mean, self.sd = np.zeros(len(self.langs)), np.full(len(self.langs), np.inf)

    @staticmethod
    def _collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        table = counts.select("lang", "gram", "n").toArrow()
        names = np.array(table.column("lang").to_pylist(), object)
        key, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        by_key = np.argsort(key)
        names, key, n = names[by_key], key[by_key], n[by_key].astype(float)
        return {x: (key[names == x], n[names == x]) for x in set(names)}

    def part(self, i: int) -> Model:
        none = (np.empty(0, np.uint64), np.empty(0))
        got = self._collected(self.counts.where(_slice(F.col("gram"), self.parts) == i))
        return Model({x: got.get(x, none) for x in self.langs}, self.ends)

    def measured(self, rows: DataFrame) -> DataFrame:
        """rows (with text) and h, the bits a character in each language; a pass for each slice."""
        sc = rows.sparkSession.sparkContext
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "langid-rows")
        sums = None
        for i in range(self.parts):
            model = sc.broadcast(self.part(i))
            one = stored(map_batches(rows.select("row", "text"), _Bits(model, i, self.parts), "row long, part int, n long, bits array<double>"), "langid-bits")
            model.destroy()
            sums = one if sums is None else sums.unionByName(one)
        total = F.aggregate(F.sort_array(F.collect_list(F.struct("part", "bits"))), F.array_repeat(F.lit(0.0), len(self.langs)), lambda a, x: F.zip_with(a, x["bits"], lambda p, q: p + q))
        sums = sums.groupBy("row").agg(F.transform(total, lambda b: b / F.greatest(F.max("n"), F.lit(1))).alias("h"))
        return rows.join(sums, "row").drop("row")


class _Bits:
    def __init__(self, model, part: int, parts: int):
        self.model, self.part, self.parts = model, part, parts

    def __call__(self, batches):
        m = self.model.value
        for b in batches:
            for texts, (row,) in _rows(b, "row", langs=len(m.langs)):
                key, first = grams(texts)
                bits = m.bits(key, first, _slice(key, self.parts) == self.part)
                yield pa.RecordBatch.from_arrays([row, pa.array([self.part] * len(texts), pa.int32()), pa.array(np.diff(first), pa.int64()), pa.array(bits.tolist(), pa.list_(pa.float64()))], ["row", "part", "n", "bits"])


def _rows(batch, *names, langs: int = 4):
    """(text list, columns) of a block of rows, null as ''; blocks are smaller for many languages."""
    texts = T.column(batch, "text")
    for r0, r1, _, _ in T.blocks(texts, T.BLOCK_BYTES * 4 // max(4, langs)):
        yield pc.fill_null(texts[r0:r1], "").to_pylist(), [T.column(batch, n)[r0:r1] for n in names]


class _Count:
    """Grams of each language, summed within the task before they are shuffled."""

    def __init__(self, most: int = 2_000_000):
        self.most = most

    def __call__(self, batches):
        held: dict[str, list] = {}
        size = 0
        for b in batches:
            for texts, (lang,) in _rows(b, "lang"):
                lang = np.array(lang.to_pylist(), object)
                for x in set(lang):
                    key, _ = grams([texts[i] for i in np.flatnonzero(lang == x)])
                    keys, count = np.unique(key, return_counts=True)
                    held.setdefault(x, []).append((keys, count))
                    size += len(keys)
            if size > self.most:
                held = {x: [self.merged(parts)] for x, parts in held.items()}
                if sum(len(p[0][0]) for p in held.values()) > self.most / 2:
                    yield from self.out(held)
                    held = {}
                size = sum(len(p[0][0]) for p in held.values())
        yield from self.out({x: [self.merged(parts)] for x, parts in held.items()})

    @staticmethod
    def merged(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    @staticmethod
    def out(held):
        for x, [(keys, count)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(count)], ["lang", "gram", "n"])


class _Entropy:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        m = self.model.value
        for b in batches:
            for texts, (lang,) in _rows(b, "lang", langs=len(m.langs)):
                h = m.entropy(*grams(texts))
                own = np.array([m.langs.index(x) if x in m.langs else -1 for x in lang.to_pylist()])
                ok = own >= 0
                yield pa.RecordBatch.from_arrays([lang.filter(pa.array(ok)), pa.array(h[ok, own[ok]])], ["lang", "h"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", calibration_part: int = 32, slice_grams: int = 2_000_000) -> Model | Sliced:
    """Count over all labelled rows; a model holds all their grams."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    aside = F.pmod(F.xxhash64("text", "lang"), F.lit(calibration_part)) == 0
    kinds = "lang string, gram long, n long"
    taught = map_batches(rows.where(~aside), _Count(), kinds).withColumn("first", F.col("n"))
    later = map_batches(rows.where(aside), _Count(), kinds).withColumn("first", F.lit(0).cast("long"))
    counts = stored(taught.unionByName(later).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("first").alias("first")), "langid-counts")

    def model_of(counts):
        parts = -(-counts.count() // slice_grams)
        return Sliced(counts, parts) if parts > 1 else Model(Sliced._collected(counts))

    first = model_of(counts.where("first > 0").select("lang", "gram", F.col("first").alias("n")))
    model = model_of(counts.select("lang", "gram", "n"))
    if first.langs:
        for r in _entropies(rows.where(aside), first).groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s"), F.count("h").alias("n")).collect():
            j = model.langs.index(r["lang"])
            if r["n"] >= 5:
                model.mean[j], model.sd[j] = r["m"], max(r["s"], 0.05)
    return model


def _entropies(rows: DataFrame, model: Model | Sliced) -> DataFrame:
    """lang, h: bits a character of each row in its own language."""
    if isinstance(model, Sliced):
        at = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int")
        return model.measured(rows).where(at > 0).select("lang", F.element_at("h", at).alias("h"))
    return map_batches(rows, _Entropy(rows.sparkSession.sparkContext.broadcast(model)), "lang string, h double")


PREDICTION = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


class _Names:
    """What a prediction needs of a model whose entropies are known."""

    def __init__(self, langs, mean, sd):
        self.langs, self.mean, self.sd = langs, mean, sd


class _Predict:
    def __init__(self, model, reject_sd):
        self.model, self.sd = model, reject_sd

    def __call__(self, batches):
        m = self.model.value
        for b in batches:
            for texts, (ids, *h) in _rows(b, *[x for x in ("doc_id", "h") if x in b.schema.names], langs=len(m.langs)):
                n = len(texts)
                if not m.langs:
                    cols = [["und"] * n, [0.0] * n, [None] * n, [True] * n]
                else:
                    h = np.array(h[0].to_pylist()).reshape(n, -1) if h else m.entropy(*grams(texts))
                    best = h.argmin(1)
                    odds = np.exp2(-ODDS_CHARS * (h - h.min(1)[:, None]))
                    score, low = 1 / odds.sum(1), h[np.arange(n), best]
                    rejected = low > m.mean[best] + self.sd * m.sd[best]
                    und = np.array([not has_letter(t) for t in texts])
                    cols = [["und" if u else m.langs[j] for u, j in zip(und, best, strict=True)], np.where(und, 0.0, score), [None if u else x for u, x in zip(und, low.tolist(), strict=True)], rejected | und]
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", reject_sd: float = 6.0) -> DataFrame:
    """One row for each document: lang_pred, score, cross_entropy (bits a character), rejected."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if isinstance(model, Sliced):
        docs, model = model.measured(docs), _Names(model.langs, model.mean, model.sd)
    return map_batches(docs, _Predict(docs.sparkSession.sparkContext.broadcast(model), reject_sd), PREDICTION)
