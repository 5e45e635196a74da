"""Quality rules: a linear-chain conditional random field labels every line of a text.

Labels are 0 (content) and 1 (boilerplate).  A line's features are bits of its shape
(``FEATURES``); the chain adds a weight for each pair of neighbouring labels.  Weights are
trained on documents that carry a quality label.  Labels of *lines* are latent: first a line's
look alone is weighed (logistic regression over lines of good and bad documents), which says
how much more common it is in bad ones; so a good document may hold lines that count as boilerplate and a
bad one lines that count as content.  The chain is then fitted to these soft line labels, held between
``1 - MOST_SURE`` and ``MOST_SURE``: the gradient is the feature count that they give less the
expected one, by forward-backward (Adam, L2).  Documents weigh alike however long they are.
The training sample is bounded by ``max_train_docs`` documents
and ``max_train_lines`` lines (taken in hash order of ids; one that no longer fits is left out), and long ones are trained on in runs of ``RUN`` lines, so a fit's memory
is bounded by lines; all else reads every row.

Viterbi decoding labels the lines of every text.  ``content_share`` is the share of a
text's words that stand in content lines.  A document is kept if no base rule fails and
its content share is ``min_content_share`` at least.  Base rules: fewer than 20 words, or
more than 30 % of the words in 8-word windows that occur twice in the text.

Defined results: a null or blank text has no words and fails the base rule; lines without
words are decoded as others but weigh nothing; without usable labels the fixed
``PRIOR`` weights decode; repeated rows give a row each; of labelled rows of one id the
least text is trained on; ties in decoding are content; further columns are ignored by
``quality`` and passed on by ``keep_quality``, whatever their names; a null id is an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .shared import collected_within, map_batches

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

# Features of a line, each with its weight towards boilerplate where no labels can be had.
PRIOR = {
    "bias": -2.0,
    "no words": 0.0,
    "1 to 3 words": 0.3,
    "over 8 words": -0.5,
    "has symbols": 0.3,
    "symbols over 3 %": 1.5,
    "symbols over 10 %": 1.5,
    "capitals over 30 %": 1.0,
    "capitals over 60 %": 1.0,
    "exclamation over 3 %": 1.0,
    "exclamation over 10 %": 1.0,
    "digits over 25 %": 1.0,
    "two bars or more": 1.0,
    "line repeated": 2.0,
    "words repeated": 2.0,
    "no closing mark": 0.3,
    "long words": 0.5,
    "first line": 0.0,
    "last line": 0.0,
}
PRIOR_CHAIN = ((0.5, -0.5), (-0.5, 0.5))
FEATURES = list(PRIOR)

_SYMBOL = T._lut(lambda b: chr(b) in "#*$%&|<>")
_UPPER, _LOWER = T._lut(lambda b: 0x41 <= b <= 0x5A), T._lut(lambda b: 0x61 <= b <= 0x7A)
_DIGIT, _BANG, _BAR = T._lut(lambda b: 0x30 <= b <= 0x39), T._lut(lambda b: b == 0x21), T._lut(lambda b: b == 0x7C)
_LEAD = T._lut(lambda b: b & 0xC0 != 0x80)
_CLOSING = T._lut(lambda b: chr(b) in ".!?:;\"')")


class Page:
    """Counts, lines and line features of a block of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = w = T.Words(data, offs, T.NONBLANK, False)
        self.lines = ln = T.Lines(data, offs)

        def sums(mask, start, end):
            s = np.zeros(len(data) + 1, np.int32)
            np.cumsum(mask, out=s[1:], dtype=np.int32)
            return s[end] - s[start]

        inside = T.NONBLANK[data]
        self.n_words = w.counts
        self.word_chars = sums(inside & _LEAD[data], offs[:-1], offs[1:]).astype(np.int64)
        symbol = _SYMBOL[data]
        self.n_symbols = sums(symbol, offs[:-1], offs[1:]).astype(np.int64)
        at, h = w.windows(REPEAT_WINDOW)
        _, twice = T.repeated(w.row[at], h)
        again = w.covered(at[twice], REPEAT_WINDOW)
        self.n_repeat_words = w.by_row(again)
        self.line_of_word = np.searchsorted(ln.starts, w.starts, "right") - 1
        self.line_words = np.bincount(self.line_of_word, minlength=len(ln.starts)).astype(np.int64)
        filled = self.line_words > 0
        later, twice = np.zeros(len(filled), bool), np.zeros(len(filled), bool)
        later[filled], twice[filled] = T.repeated(ln.row[filled], ln.hash[filled])
        self.n_dup_lines = T.row_sums(later, ln.first)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)
        # features
        a, b = ln.starts, ln.ends
        chars = np.maximum(sums(inside & _LEAD[data], a, b), 1)
        upper, lower = sums(_UPPER[data], a, b), sums(_LOWER[data], a, b)
        share = {"symbol": sums(symbol, a, b) / chars, "upper": upper / np.maximum(upper + lower, 1), "bang": sums(_BANG[data], a, b) / chars, "digit": sums(_DIGIT[data], a, b) / chars}
        redone = np.bincount(self.line_of_word, weights=again, minlength=len(a)) > 0.5 * self.line_words
        end = np.zeros(len(a), bool)
        if len(w):
            last = np.searchsorted(w.starts, b) - 1  # the line's last word, where it has one
            end[filled] = _CLOSING[data[w.ends[last[filled]] - 1]]
        first, final = np.zeros(len(a), bool), np.zeros(len(a), bool)
        first[ln.first[:-1]], final[ln.first[1:] - 1] = True, True
        n = self.line_words
        self.features = np.stack(
            [np.ones(len(a), bool), n == 0, (n >= 1) & (n <= 3), n > 8, share["symbol"] > 0, share["symbol"] > 0.03, share["symbol"] > 0.1, share["upper"] > 0.3, share["upper"] > 0.6, share["bang"] > 0.03, share["bang"] > 0.1, share["digit"] > 0.25, sums(_BAR[data], a, b) >= 2, twice, redone & filled, ~end, chars > 12 * np.maximum(n, 1), first, final],
            axis=1,
        )


class Model:
    """weights[f] towards boilerplate; chain[a][b] for a line of label b after one of label a."""

    def __init__(self, weights, chain):
        self.weights, self.chain = np.asarray(weights, float), [list(map(float, r)) for r in chain]

    def decode(self, page: Page) -> np.ndarray:
        """The most probable labels of all lines (1: boilerplate), text by text."""
        gain = (page.features @ self.weights).tolist()
        (c00, c01), (c10, c11) = self.chain
        label = [0] * len(gain)
        first = page.lines.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            s0, s1 = 0.0, gain[a]
            back = []
            for e in gain[a + 1 : b]:
                f0, f1 = s1 + c10 > s0 + c00, s1 + c11 > s0 + c01
                back.append((f0, f1))
                s0, s1 = (s1 + c10 if f0 else s0 + c00), (s1 + c11 if f1 else s0 + c01) + e
            now = s1 > s0
            label[b - 1] = int(now)
            for i in range(b - 2, a - 1, -1):
                now = back[i - a][now]
                label[i] = int(now)
        return np.array(label, np.int64)


MOST_SURE, RUN = 0.9, 256


def _forward_backward(e: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of label 1 by line, of label pairs by neighbours) of runs side by side; m marks lines that are."""
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    t = m.shape[1]
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        new = np.logaddexp(alpha[:, i - 1, :1] + c[0], alpha[:, i - 1, 1:] + c[1]) + e[:, i]
        alpha[:, i] = np.where(m[:, i, None], new, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = beta[:, i + 1] + e[:, i + 1]
        new = np.logaddexp(c[:, 0] + ahead[:, :1], c[:, 1] + ahead[:, 1:])
        beta[:, i] = np.where(m[:, i + 1, None], new, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
    one = np.where(m, np.exp(alpha[..., 1] + beta[..., 1] - z), 0)
    ahead = (e + beta)[:, 1:]
    pair = np.exp(alpha[:, :-1, :, None] + c + ahead[:, :, None, :] - z[..., None, None])
    return one, np.where(m[:, 1:, None, None], pair, 0)


class _Adam:
    def __init__(self, n: int, rate: float):
        self.rate, self.step, self.first, self.second = rate, 0, np.zeros(n), np.zeros(n)

    def __call__(self, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first, self.second = 0.9 * self.first + 0.1 * grad, 0.99 * self.second + 0.01 * grad**2
        return self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-8)


def looks(runs, steps: int, rate: float, l2: float) -> np.ndarray:
    """Weights of a line's look towards bad documents, no neighbour counted; equal looks are taken together."""
    x = np.concatenate([f for f, *_ in runs])
    code = x @ (1 << np.arange(x.shape[1]))
    y = np.repeat([y for _, y, _ in runs], [len(f) for f, *_ in runs])
    w = np.repeat([w for *_, w in runs], [len(f) for f, *_ in runs])
    kinds, first, which = np.unique(code, return_index=True, return_inverse=True)
    bad, all_, x = np.bincount(which, w * y), np.bincount(which, w), x[first].astype(float)
    theta, move = np.zeros(x.shape[1]), _Adam(x.shape[1], rate)
    for _ in range(steps):
        theta = theta + move(x.T @ (bad - all_ / (1 + np.exp(-x @ theta))) - l2 * theta)
    return theta


def fit(docs: list[tuple[np.ndarray, int]], steps: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Model:
    """Weights from (line features, document label); runs of like length side by side."""
    if not docs or len({y for _, y in docs}) < 2:
        return Model(list(PRIOR.values()), PRIOR_CHAIN)
    share = {y: sum(1 for _, z in docs if z == y) for y in (0, 1)}
    runs = [(x[i : i + RUN], y, 1.0 / (len(x) * share[y])) for x, y in docs for i in range(0, len(x), RUN)]
    runs.sort(key=lambda r: len(r[0]))
    look, most = looks(runs, 3 * steps, rate, l2), np.log(MOST_SURE / (1 - MOST_SURE))
    theta = np.concatenate((look / 2, np.zeros(4)))
    move = _Adam(len(theta), rate / 2)
    for _ in range(steps):
        grad = np.zeros_like(theta)
        for at in range(0, len(runs), 256):  # padded to the longest run, one group at a time
            g = runs[at : at + 256]
            t = len(g[-1][0])
            x, m = np.zeros((len(g), t, len(FEATURES)), np.float32), np.zeros((len(g), t), bool)
            for i, (f, *_) in enumerate(g):
                x[i, : len(f)], m[i, : len(f)] = f, True
            weight = np.array([w for *_, w in g])
            e = np.zeros((*m.shape, 2))
            e[..., 1] = x @ theta[:-4]
            c = theta[-4:].reshape(2, 2)
            free = _forward_backward(e, c, m)
            sure = 1 / (1 + np.exp(-np.clip(x @ look, -most, most)))
            pairs = np.stack((1 - sure, sure), -1)
            pairs = np.where(m[:, 1:, None, None], pairs[:, :-1, :, None] * pairs[:, 1:, None, :], 0)
            grad[:-4] += np.einsum("ntf,nt->f", x, np.where(m, sure - free[0], 0) * weight[:, None])
            grad[-4:] += ((pairs - free[1]).sum(1) * weight[:, None, None]).sum(0).ravel()
        theta = theta + move(grad - l2 * theta)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def training_ids(labels: DataFrame, max_train_docs: int) -> DataFrame:
    """(doc_id, quality) of at most max_train_docs documents, half of either label, in hash order."""
    one = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    parts = [one.where(F.col("quality") == q).orderBy(*order).limit(max_train_docs // 2) for q in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train_docs: int = 1200, max_train_lines: int = 400_000) -> Model:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = docs.join(F.broadcast(training_ids(labels, max_train_docs)), "doc_id")  # bounded by max_train_docs
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = collected_within(map_batches(sample, _line_bits, "doc_id long, y int, n int, bits binary"), "doc_id", "y", "n", max_train_lines)
    shaped = [(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.n * len(FEATURES)).reshape(r.n, -1).astype(bool), r.y) for r in rows]
    return fit(sorted(shaped, key=lambda d: (len(d[0]), d[0].tobytes(), d[1])))


def _line_bits(batches):
    for b in batches:
        for r0, r1, data, offs in T.blocks(T.column(b, "text")):
            page = Page(data, offs)
            first = page.lines.first
            bits = [np.packbits(page.features[a:z]).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
            label = T.column(b, "quality")[r0:r1].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], pa.array(1 - label.astype(np.int32)), pa.array(page.lines.counts.astype(np.int32)), pa.array(bits, pa.binary())], ["doc_id", "y", "n", "bits"])


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, line_labels binary"


class _Judge:
    def __init__(self, model: Model, min_content_share: float):
        self.model, self.share = model, min_content_share

    def __call__(self, batches):
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, "text")):
                p = Page(data, offs)
                label = self.model.decode(p)
                share = T.row_sums(p.line_words * (1 - label), p.lines.first) / np.maximum(p.n_words, 1)
                first = p.lines.first
                marks = [label[a:z].astype(np.uint8).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [T.column(b, "doc_id")[r0:r1], *map(pa.array, (p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed, ~p.base_failed & (share >= self.share), share, p.lines.counts)), pa.array(marks, pa.binary())],
                    [c.split()[0] for c in RULES.split(", ")],
                )


def quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", min_content_share: float = 0.5) -> DataFrame:
    """One row for each document: counts, base verdict, verdict, content share and the lines' labels."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Judge(model, min_content_share), RULES)


class _Keep:
    """Passes on the rows that quality() keeps, with all their columns."""

    def __init__(self, model: Model, text: str, min_content_share: float):
        self.model, self.text, self.share = model, text, min_content_share

    def __call__(self, batches):
        for b in batches:
            for r0, r1, data, offs in T.blocks(T.column(b, self.text)):
                p = Page(data, offs)
                share = T.row_sums(p.line_words * (1 - self.model.decode(p)), p.lines.first) / np.maximum(p.n_words, 1)
                yield b.slice(r0, r1 - r0).filter(pa.array(~p.base_failed & (share >= self.share)))


def keep_quality(docs: DataFrame, model: Model, text: str = "text", min_content_share: float = 0.5) -> DataFrame:
    """The documents that quality() keeps."""
    return map_batches(docs, _Keep(model, text, min_content_share), docs.schema)
