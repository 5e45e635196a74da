"""Token counts by a finite-state tokenizer compiled from a vocabulary file.

Two deterministic transducers count the tokens of a text without making them.

*The outer one* (``pretoken.ChunkMaps``) cuts the normalised text into pieces.  The transition
that begins a piece carries the piece's tokens.  It runs over equal chunks of a block side by
side, from every state; the chunks' maps (state behind, tokens emitted) compose through a
parallel prefix scan, which gives the counts of whole texts.

*The inner one* counts the tokens of a piece.  Its alphabet is the bytes, and the bytes
that end a piece; it is compiled from the vocabulary and its merges as far as texts ask
for it.  A state stands for what the bytes read so far decide: the last token of their
encoding, and the states before.  BPE's encoding is the one sequence of tokens in which
each neighbouring pair stays a pair when the two are encoded together, so the last token
behind a byte is the one vocabulary entry that ends there and pairs with the last token
of the state it begins at.  Every transition carries the number of tokens it emits: the
change of the count (it is negative where a byte joins tokens).  Counts add up along a
path, so a piece's count is the sum over its bytes.

States are kept up to ``MOST_STATES`` and pieces' counts up to ``Memo``'s bound; beyond
them the worker starts afresh, which costs time and changes no count.

Texts are normalised as the file says (NFC, white space, lower case), code points that Python
does not know by the library itself; special strings in a text count one token each and part
it.  Null and empty texts have no tokens; repeated rows give a row each; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken as P
from . import textscan as T
from .shared import hold, map_batches

MOST_STATES = 300_000
_loaded: dict[str, tuple] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in set(plain) else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens as byte strings, with an end mark where they end a piece, and merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}

        def raw(token: str) -> tuple[bytes, bool]:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            return b"".join(back[c] for c in body), ends

        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        special = set(self.specials)
        for token, i in model["vocab"].items():
            if token not in special:
                body, ends = raw(token)
                (self.final if ends else self.inner)[body] = i
        self.symbols: list = [None] * (max(model["vocab"].values()) + 1)
        for table, ends in ((self.inner, False), (self.final, True)):
            for body, i in table.items():
                self.symbols[i] = (body, ends)
        if not self.suffix:
            self.final = self.inner
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        name = model["vocab"]
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[name[a], name[b]] = (r, name[a + b])

    def encode(self, body: bytes, ends: bool) -> list[int]:
        """Plain BPE: the best-ranked pair merges, the leftmost first."""
        ids = [self.inner[body[i : i + 1]] for i in range(len(body))]
        if ends and ids:
            ids[-1] = self.final[body[-1:]]
        while len(ids) > 1:
            best = min(((self.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids


class Transducer:
    """The inner transducer, compiled while it runs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self):
        self.step: dict[int, int] = {}  # (state, byte) -> state
        self.emit: dict[int, int] = {}  # (state, ending byte) -> tokens that it emits
        self.parent, self.last, self.count = [-1], [-1], [0]

    def stays(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when encoded together."""
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            (x, _), (y, ends) = self.v.symbols[a], self.v.symbols[b]
            known = self.pairs[key] = self.v.encode(x + y, ends) == [a, b]
        return known

    def _behind(self, state: int, text: bytes, end: int, table: dict) -> tuple[int, int]:
        """(last token, tokens) behind text[:end] if text[:end - 1] led to the state."""
        at = state
        for size in range(1, min(end, self.v.longest) + 1):
            token = table.get(text[end - size : end])
            if token is not None and (at == 0 or self.stays(self.last[at], token)):
                return token, self.count[at] + 1
            at = self.parent[at]
        raise ValueError(f"no token ends {text[:end]!r}")

    def tokens(self, piece: bytes) -> int:
        """The sum of what the transitions over a piece emit."""
        state, n = 0, 0
        for i, byte in enumerate(piece[:-1]):
            edge = state << 8 | byte
            ahead = self.step.get(edge)
            if ahead is None:
                token, count = self._behind(state, piece, i + 1, self.v.inner)
                ahead = self.step[edge] = len(self.parent)
                self.parent.append(state)
                self.last.append(token)
                self.count.append(count)
            n += self.count[ahead] - self.count[state]
            state = ahead
        edge = state << 8 | piece[-1]
        out = self.emit.get(edge)
        if out is None:
            out = self.emit[edge] = self._behind(state, piece, len(piece), self.v.final)[1] - self.count[state]
        if len(self.parent) + len(self.emit) > MOST_STATES:
            self.clear()
        return n + out


def loaded(path: str) -> tuple[Vocabulary, Transducer, P.Memo, P.CodePoints]:
    if path not in _loaded:
        v = Vocabulary(path)
        _loaded[path] = (v, Transducer(v), P.Memo(), P.CodePoints(path))
        hold("token_fst", _loaded.clear)
    return _loaded[path]


def count_tokens(texts: list[str], path: str, chunk: int | None = None) -> np.ndarray:
    """Tokens of each text."""
    v, transducer, memo, known = loaded(path)
    owner, parts, extra = None, texts, np.zeros(len(texts), np.int64)
    joined = "".join(texts)
    if any(s in joined for s in v.specials):  # special strings part their text
        cut = re.compile("|".join(map(re.escape, v.specials)))
        split = [cut.split(t) for t in texts]
        extra = np.array([len(s) - 1 for s in split], np.int64)
        owner, parts = np.repeat(np.arange(len(texts)), extra + 1), [p for s in split for p in s]
    maps = P.ChunkMaps(*known.normalised(parts), known.kind, chunk)
    start, end, points = maps.start, maps.end, maps.points
    if not len(start):
        return extra
    distinct, first, which = np.unique(P.piece_hashes(points, start, end), return_index=True, return_inverse=True)

    def compute(new):
        spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
        return [transducer.tokens(points[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")) for a, b in spans]

    n = maps.totals(memo.get(distinct, compute)[which])
    if memo.full:
        memo.clear()
    return extra + (n if owner is None else np.bincount(owner, n, len(texts)).astype(np.int64))


class _Count:
    def __init__(self, path, limit):
        self.path, self.limit = path, limit

    def __call__(self, batches):
        for b in batches:
            for r0, r1, texts in P.text_lists(b):
                n = count_tokens(texts, self.path)
                size = [len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id")[r0:r1], pa.array(size, pa.int64()), pa.array(n), pa.array(n > self.limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each document: n_bytes, n_tokens, over_limit. path: a vocabulary file that executors have too."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "token_fst")
