"""Text rules as column expressions, and the sequential loop cutter as a pandas UDF."""

import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marks of the data format.
STUB = r"<!--\s*MUSIC_STUB_ID:\s*(.*?)\s*-->"
PAGE_BREAK = "\n\n---\n\n"
UNNAMED = "unnamed_book"
FAILED = "% [OMR Conversion Error"


def book_title(name: Column) -> Column:
    """A title that can be a folder name."""
    safe = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(UNNAMED))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def strip_fences(text: Column) -> Column:
    """Without thinking passages and one Markdown fence around the whole, loops cut."""
    out = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    out = strip(F.regexp_replace(out, r"(?s)\A.*?</think>", ""))
    out = strip(F.regexp_replace(out, r"\A```(markdown|md)?", ""))
    return cut_loops(strip(F.regexp_replace(out, r"```\z", "")))


def cut_inline_loops(text: Column) -> Column:
    """A phrase of 12 to 120 characters that stands three times or more in a row stays twice."""
    return over_texts(text, lambda texts: [phrases_cut(t, p) if p else t for t, p in zip(texts, loop_lengths(texts), strict=True)])


def streaming_loop(tail: Column) -> Column:
    """Whether a text ends in a phrase (8 to 120 characters) or in a block of 1 to 5 lines three times over."""
    s = strip(tail)
    most = F.least(F.lit(120), F.floor(F.length(s) / 3).cast("int"))
    phrase = F.when(most >= 8, F.exists(F.sequence(F.lit(8), F.greatest(most, F.lit(8))), lambda m: F.endswith(s, F.repeat(F.right(s, m), 3)))).otherwise(False)
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: strip(x)), lambda x: x != "")
    n = F.size(lines)
    block = F.exists(F.array(*map(F.lit, range(1, 6))), lambda p: (n >= p * 3) & (F.slice(lines, F.greatest(n - p + 1, F.lit(1)), p) == F.slice(lines, F.greatest(n - 2 * p + 1, F.lit(1)), p)) & (F.slice(lines, F.greatest(n - p + 1, F.lit(1)), p) == F.slice(lines, F.greatest(n - 3 * p + 1, F.lit(1)), p)))
    return F.coalesce((F.length(tail) >= 24) & (phrase | block), F.lit(False))


def loops_at_end(tail: str) -> bool:
    """streaming_loop of one text, for sequential readers."""
    if len(tail) < 24:
        return False
    s = tail.strip()
    if any(s.endswith(s[-m:] * 3) for m in range(8, min(120, len(s) // 3) + 1)):
        return True
    lines = [x.strip() for x in tail.splitlines() if x.strip()]
    return any(lines[-p:] == lines[-2 * p : -p] == lines[-3 * p : -2 * p] for p in range(1, 6) if len(lines) >= 3 * p)


def html_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def stub_id(page: Column, staff: Column, kind: Column) -> Column:
    return F.format_string("P%04d_S%02d_%s", page, staff, kind)


def stub_class(stub: Column) -> Column:
    """Class named in a stub id; grand staves before systems before staves."""
    return F.when(stub.contains("grand_staff"), "grand_staff").when(stub.contains("system"), "system").otherwise("staff")


def fenced(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"```{kind}\n"), strip(body), F.lit("\n```"))


def stays_in_runs(bodies: np.ndarray, filled: np.ndarray, most: int = 2) -> np.ndarray:
    """Which lines stay when runs of equal filled lines are held to `most`; blank lines go with the filled one behind them."""
    at = np.flatnonzero(filled)
    place = np.arange(len(at))
    opens = np.ones(len(at), bool)
    opens[1:] = bodies[at[1:]] != bodies[at[:-1]]
    stays = place - np.maximum.accumulate(np.where(opens, place, 0)) < most
    out = np.append(stays, True)[np.searchsorted(at, np.arange(len(filled)))]
    return out


def stays_in_cycles(lines: np.ndarray, filled: np.ndarray, most: int = 2) -> np.ndarray:
    """Which lines stay when blocks of 2 to 8 lines that stand three times or more in a row are held to `most`.

    How far lines equal those a block ahead gives the repeats at every place; the shortest block counts.
    """
    n = len(lines)
    size, span = np.zeros(n, np.int64), np.zeros(n, np.int64)
    inked = np.concatenate(([0], np.cumsum(filled)))
    for k in range(2, 9):
        m = n - k
        if m < 2 * k:
            break
        breaks = np.append(np.flatnonzero(lines[k:] != lines[:m]), m)
        stretch = breaks[np.searchsorted(breaks, np.arange(m))] - np.arange(m)
        hit = (stretch >= 2 * k) & (inked[k : k + m] > inked[:m]) & (size[:m] == 0)
        size[:m][hit], span[:m][hit] = k, (stretch[hit] // k + 1) * k
    out, begins, free = np.ones(n, bool), np.flatnonzero(size), 0
    for i in begins.tolist():
        if i >= free:
            free = i + int(span[i])
            out[i + most * int(size[i]) : free] = False
    return out


def phrases_cut(text: str, lengths: list[int], most: int = 2) -> str:
    """re.sub(r"([^\\n]{12,120}?)\\1{2,}", ...) with phrases of the given lengths, in ascending order, held to `most`.

    A run of places that equal those p behind them, 2 p long or longer, is where phrases of p characters
    match. The leftmost match counts, of several there the shortest, and it takes all its repeats.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    runs = []
    for p in lengths:
        breaks = np.concatenate(([-1], np.flatnonzero(codes[p:] != codes[:-p]), [max(0, len(codes) - p)]))
        for i in np.flatnonzero(np.diff(breaks) > 2 * p).tolist():
            first, end = int(breaks[i]) + 1, int(breaks[i + 1])
            if (codes[first : first + p] != 10).all():
                runs.append((first, p, end))
    heapq.heapify(runs)
    out, free = [], 0
    while runs:
        first, p, end = heapq.heappop(runs)
        if first < free:
            if free + 2 * p <= end:
                heapq.heappush(runs, (free, p, end))
            continue
        out.append(text[max(0, free) : first + most * p])
        free = first + ((end - first) // p + 1) * p
    return "".join([*out, text[free:]])


def loops_cut(text: str | None, most: int = 2, lengths: list[int] | None = None) -> str | None:
    """All three passes in order: phrases (of the given lengths, or of any), lines, blocks."""
    if not text:
        return text
    if lengths is None:
        text = re.sub(r"([^\n]{12,120}?)\1{2,}", lambda m: m[1] * most, text)
    elif lengths:
        text = phrases_cut(text, lengths, most)
    lines = text.splitlines()
    bodies = [x.strip() for x in lines]
    seen = {x: i for i, x in enumerate(bodies)}
    if len(bodies) - len(seen) > max(0, bodies.count("") - 1):  # some filled line stands twice, else nothing can loop
        filled, body = np.array([x != "" for x in bodies]), np.array([seen[x] for x in bodies])
        stays = stays_in_runs(body, filled, most)
        lines, filled = [x for x, s in zip(lines, stays.tolist(), strict=True) if s], filled[stays]
        name = {x: i for i, x in enumerate(lines)}
        stays = stays_in_cycles(np.array([name[x] for x in lines], np.int64), filled, most)
        lines = [x for x, s in zip(lines, stays.tolist(), strict=True) if s]
    return "\n".join(lines)


def cut_loops(text: Column) -> Column:
    """The sequential passes need state, so they run as one Arrow-batched UDF."""
    return F.pandas_udf(_cut_batch, "string")(text)


def loop_lengths(texts: list[str]) -> list[list[int]]:
    """Lengths of phrases that the phrase pass may find in each text, ascending: none is missing that it does find.

    A phrase of p characters three times over is a run of 2 p characters that are equal to
    those p behind them, so five places in a row, p // 3 apart, are.
    """
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, found = np.cumsum([len(t) + 1 for t in texts]), [[] for _ in texts]
    for p in range(12, min(121, len(codes))):
        same = codes[: -p : p // 3] == codes[p :: p // 3]
        run = np.flatnonzero(same[:-4] & same[1:-3] & same[2:-2] & same[3:-1] & same[4:])
        if len(run):
            for i in np.unique(np.searchsorted(ends, run * (p // 3), "right")).tolist():
                found[i].append(p)
    return found


def _by_blocks(texts: Iterable, fn: Callable[[list[str]], list[str]]) -> Iterator[list]:
    """Results of fn over blocks of bounded size; nulls stay."""
    block, size = [], 0
    for text in texts:
        block.append(text if isinstance(text, str) else None)
        size += len(block[-1] or "")
        if size > 1 << 18 or len(block) >= 256:
            yield _block(block, fn)
            block, size = [], 0
    if block:
        yield _block(block, fn)


def _block(block: list, fn: Callable[[list[str]], list[str]]) -> list:
    done = fn([t or "" for t in block])
    return [None if t is None else d for t, d in zip(block, done, strict=True)]


def over_texts(text: Column, fn: Callable[[list[str]], list[str]]) -> Column:
    """fn of blocks of texts as a column."""

    def batch(s: pd.Series) -> pd.Series:
        return pd.Series([t for b in _by_blocks(s, fn) for t in b], index=s.index, dtype=object)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(text)


def _cut_all(texts: list[str]) -> list[str]:
    return [loops_cut(t, lengths=p) for t, p in zip(texts, loop_lengths(texts), strict=True)]


def _cut_batch(s: pd.Series) -> pd.Series:
    return pd.Series([t for b in _by_blocks(s, _cut_all) for t in b], index=s.index, dtype=object)
