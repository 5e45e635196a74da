"""Cutting texts into the pieces that BPE works on, over code points, and counting distinct ones.

What a code point is (letter, number, white space, other) and its lower case are asked of
the tokenizer library itself, once a worker, so they follow its version of Unicode and not
Python's.  Texts are parted by ``MARK``, which is no code point, so any text goes through as it is.

``ChunkMaps`` runs a deterministic finite-state transducer over a block in equal chunks
side by side.  A transition that begins a piece is annotated with the tokens that the piece
emits.  A chunk's map says, for each state it may be entered in, the state behind it and
the tokens emitted on the way; all maps compose through a parallel prefix scan
(log2(chunks) compositions), and a text's count is the difference of two prefixes.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textscan as T

SPACE, LETTER, NUMBER, OTHER, END = range(5)
MARK = 0x110000  # stands between texts: one more than the last code point
_points = T._Powers(0xA0761D6478BD642F)


class CodePoints:
    """Classes and lower case of all code points, as the library of a vocabulary file has them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["added_tokens"], spec["post_processor"], spec["decoder"] = [], None, None
        spec["model"] = spec["model"] | {"vocab": {}, "merges": []}
        library = Tokenizer.from_str(json.dumps(spec))
        self.normalizer = library.normalizer
        self.kind = self._kinds(library.pre_tokenizer.pre_tokenize_str)
        if self.normalizer is not None:
            self._lower()

    @staticmethod
    def _kinds(cut) -> np.ndarray:
        """Blocks of one class are told by one call; in the others each code point is tried behind a letter and so on."""
        out = np.full(MARK + 1, OTHER, np.uint8)
        out[MARK] = END

        def joins(lead, text):
            pieces = cut(lead + text)
            return len(pieces) == 1 and pieces[0][1] == (0, len(lead + text))

        for first in range(0, MARK, 256):
            if 0xD800 <= first < 0xE000:
                continue
            block = "".join(map(chr, range(first, first + 256)))
            if joins("!", block):
                continue
            if joins("a", block):
                out[first : first + 256] = LETTER
                continue
            for c, x in enumerate(block, first):
                if joins("a", x):
                    out[c] = LETTER
                elif not joins("!", x):
                    gone = not any(a <= 1 < z for _, (a, z) in cut(f"a{x}a"))
                    out[c] = SPACE if gone or joins("\n", x) else NUMBER
        return out

    def _lower(self) -> None:
        """lower: each code point normalised by itself; asks: those whose texts the library has to normalise."""
        self.lower = np.arange(MARK + 1, dtype=np.uint32)
        self.asks = np.zeros(MARK + 1, bool)
        for first in range(0, MARK, 1 << 14):
            own = [c for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000 and c != 0x5F]
            for c, x in zip(own, self.normalizer.normalize_str("_".join(map(chr, own))).split("_"), strict=True):
                if len(x) == 1:
                    self.lower[c] = ord(x)
                else:
                    self.asks[c] = True
        # normal forms of assigned code points never change; of newer ones only the library may know
        self.asks[[c for c in range(MARK) if unicodedata.category(chr(c)) == "Cn"]] = True

    def normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code points, edges) of the normalised texts, end to end."""
        joined = "".join(texts)
        points, edges = code_points(texts, joined)
        if not joined.isascii():
            odd = set(np.searchsorted(edges, np.flatnonzero(self.asks[points]), "right") - 1)
            if not unicodedata.is_normalized("NFC", joined):
                odd |= {i for i, t in enumerate(texts) if not unicodedata.is_normalized("NFC", t)}
            if odd:
                points, edges = code_points([self.normalizer.normalize_str(t) if i in odd else t for i, t in enumerate(texts)])
        return self.lower[points], edges


def code_points(texts: list[str], joined: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(("".join(texts) if joined is None else joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def with_marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each led in by MARK and a last one behind; place of each mark."""
    points, edges = code_points(texts)
    marks = edges + np.arange(len(edges))
    out = np.empty(len(points) + len(edges), np.uint32)
    own = np.ones(len(out), bool)
    own[marks] = False
    out[own], out[marks] = points, MARK
    return out, marks


def contractions(points: np.ndarray) -> np.ndarray:
    """Length of the contraction ('s 't 'm 'd: 2; 're 've 'll: 3) that an apostrophe would begin, else 0."""
    out = np.zeros(len(points), np.uint8)
    at = np.flatnonzero(points[:-2] == 0x27)
    if len(at):
        a, b = points[at + 1], points[at + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[two]], out[at[three]] = 2, 3
    return out


# symbols: the classes, then an apostrophe before a contraction of 2 and of 3
_START, _LETTERS, _OTHERS, _ONE_MORE, _TWO_MORE = range(5)
_NEXT = np.empty((5, 7), np.int16)
_EMIT = np.zeros((5, 7), bool)
for _s in (_START, _LETTERS, _OTHERS):
    _NEXT[_s] = [_START, _LETTERS, _START, _OTHERS, _START, _ONE_MORE, _TWO_MORE]
    _EMIT[_s] = [False, True, True, True, False, True, True]
_EMIT[_LETTERS, LETTER] = False
_NEXT[_OTHERS, [OTHER, 5, 6]] = _OTHERS
_EMIT[_OTHERS, [OTHER, 5, 6]] = False
_NEXT[_ONE_MORE], _NEXT[_TWO_MORE] = _START, _ONE_MORE


class ChunkMaps:
    """Pieces of texts (contractions, letter runs, single numbers, runs of others; white space dropped) and their counts.

    Every text begins a chunk and ends in blank padding, so it is entered and left in the
    starting state.  A piece that some entry state would begin is looked at whether or not
    its chunk is entered so: where a piece ends depends on where it begins alone.
    """

    def __init__(self, points: np.ndarray, edges: np.ndarray, kind: np.ndarray, chunk: int | None = None):
        size = np.diff(edges)
        if chunk is None:  # short texts take short chunks, so that padding stays small
            chunk = 1 << min(8, max(4, int(len(points) // max(1, len(size))).bit_length() - 2))
        self.first = np.concatenate(([0], np.cumsum(size // chunk + 1)))
        self.chunk, m = chunk, int(self.first[-1])
        self.points = np.full(m * chunk, 0x20, np.uint32)
        self.points[np.arange(len(points)) + np.repeat(self.first[:-1] * chunk - edges[:-1], size)] = points
        symbol = kind[self.points]
        short = contractions(self.points)
        at = np.flatnonzero(short)
        symbol[at] = short[at] + 3
        states = len(_NEXT)
        self.maps = np.tile(np.arange(states, dtype=np.int16), (m, 1))
        emits = np.empty((chunk, m, states), bool)
        step, emit = _NEXT.ravel(), _EMIT.ravel()
        for i, column in enumerate(np.ascontiguousarray(symbol.reshape(m, chunk).T)):
            edge = self.maps * np.int16(7) + column[:, None]
            emits[i], self.maps = emit[edge], step[edge]
        self.start = np.flatnonzero(emits.any(2).T.ravel())
        self.emits = emits[self.start % chunk, self.start // chunk]  # (start, entry state)
        self.end = self._ends(symbol)

    def _ends(self, symbol: np.ndarray) -> np.ndarray:
        own = symbol[self.start]
        end = self.start + np.array([0, 1, 1, 1, 0, 2, 3])[own]
        for of, beyond in ((LETTER, symbol != LETTER), (OTHER, (symbol != OTHER) & (symbol <= END))):
            runs, stops = own == of, np.flatnonzero(beyond)
            end[runs] = stops[np.searchsorted(stops, self.start[runs])]
        return end

    def totals(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens of each text, given those of the pieces that begin at start."""
        m, states = self.maps.shape
        maps = self.maps.astype(np.int64)
        counts = np.empty((m, states), np.int64)
        for s in range(states):
            taken = self.emits[:, s]
            counts[:, s] = np.bincount(self.start[taken] // self.chunk, tokens[taken], m)
        step = 1
        while step < m:  # parallel prefix scan: each map becomes that of all chunks up to it
            behind, sums = maps.copy(), counts.copy()
            behind[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            sums[step:] = counts[:-step] + np.take_along_axis(counts[step:], maps[:-step], axis=1)
            maps, counts, step = behind, sums, 2 * step
        return np.diff(np.concatenate(([0], counts[:, _START]))[self.first])


def runs_with_spaces(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece where a blank leads the run behind it and nothing is dropped.

    A run of white space gives up its last character if more text follows: a blank to the
    next run, another one as a piece of its own.
    """
    kind = kind[points]
    n = len(points)
    before, behind = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[0], before[1:] = END, kind[:-1]
    behind[-1], behind[:-1] = END, kind[1:]
    blank_before = np.empty(n, bool)
    blank_before[0], blank_before[1:] = False, points[:-1] == 0x20
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | ((behind != SPACE) & (behind != END)), (kind != before) & ~blank_before)
    short = contractions(points)
    at = np.flatnonzero(short)
    at = at[(before[at] != OTHER) & ~blank_before[at]]
    start[at + 1] = False
    after = at + short[at]
    start[after[kind[after] == LETTER]] = True
    start &= kind != END
    first = np.flatnonzero(start)
    marks = np.flatnonzero(kind == END)
    return first, np.minimum(np.append(first[1:], n), marks[np.searchsorted(marks, first)])


def piece_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return T.span_hash(lambda a, b: points[a:b].astype(np.uint64) + np.uint64(1), _points)(start, end)


class Memo:
    """Values of pieces by hash, in a few sorted arrays of growing size; started anew beyond ``most`` pieces."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.clear()

    def clear(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def get(self, distinct: np.ndarray, compute) -> np.ndarray:
        """Values of sorted distinct keys; compute(indices) gives those of the unknown ones."""
        out, todo = np.zeros(len(distinct), np.int64), np.arange(len(distinct))
        for keys, values in self.levels:
            at = T.lookup(keys, distinct[todo])
            known = at >= 0
            out[todo[known]] = values[at[known]]
            todo = todo[~known]
        if len(todo):
            out[todo] = compute(todo)
            if len(self) + len(todo) <= self.most:
                self._add(distinct[todo], out[todo])
        return out

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):  # a level is twice as large as the next one
            k, v = self.levels.pop()
            keys, values = np.concatenate((k, keys)), np.concatenate((v, values))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        self.levels.append((keys, values))

    @property
    def full(self) -> bool:
        return len(self) > 0.9 * self.most


def text_lists(batch: pa.RecordBatch, name: str = "text"):
    """(first row, end row, texts) of blocks of rows; null as ''."""
    texts = T.column(batch, name)
    for r0, r1, _, _ in T.blocks(texts):
        yield r0, r1, pc.fill_null(texts[r0:r1], "").to_pylist()
