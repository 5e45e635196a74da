"""Page streams: micro-batches drained once, a stateful page filter, loop stop, and a bounded log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH, TAIL = 6, 1200  # files in a batch; characters of a reply that the loop check sees


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, once, into a table that outlives it; a second run takes up where this one ended."""
    out, marks = f"{folder}/out", f"{folder}/marks"
    query = stream.writeStream.format("parquet").option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/marks").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def files(spark, path: str, schema, most_files: int = BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


SKIP, BUCKETS = "book long, p int, action string", 1024


def _skip(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The pages of a bucket's books; state: books, and for each 1 if it has started, 2 if it is latched."""
    rows = pd.concat(batches, ignore_index=True)
    seen = dict(zip(*json.loads(state.get[0]), strict=True)) if state.exists else {}
    order = np.lexsort((rows["p"], rows["book"], rows["none"]))
    none, book, p, n, music = (rows[c].to_numpy()[order] for c in ("none", "book", "p", "n", "cnt"))
    music, multi = music > 0, rows["multi"].eq(True).to_numpy(bool)[order]
    opens = np.append(True, (book[1:] != book[:-1]) | (none[1:] != none[:-1]))
    first, of = np.flatnonzero(opens), opens.cumsum() - 1
    books = [None if x else k for x, k in zip(none[first].tolist(), book[first].tolist(), strict=True)]
    had = np.array([seen.get(k, 0) for k in books])

    def so_far(hit):
        """How often in a book's pages up to each one."""
        n = hit.cumsum()
        return n - (n - hit)[first][of]

    started = (so_far(music) - music > 0) | (had & 1 > 0)[of]
    front = np.maximum(5, n * 15 // 100)
    early = ~music & ~started & (p <= front)
    late = ~music & ~early & (p >= np.maximum(front + 1, n - n * 12 // 100 + 1))
    latched = (so_far(late & multi) > 0) | (had & 2 > 0)[of]
    last = np.append(first[1:], len(p)) - 1
    seen.update(zip(books, ((started | music)[last] + 2 * latched[last]).tolist(), strict=True))
    state.update((json.dumps([list(seen), list(seen.values())]),))
    action = np.where(early, "front", np.where(late & latched, "back", "keep"))
    yield pd.DataFrame({"book": pd.Series(book, dtype="Int64").mask(pd.Series(none)), "p": p, "action": action})


def page_filter(pages: DataFrame) -> DataFrame:
    """The batch filter's two latches as state of each book. pages: (book, p, n, cnt, multi), in page order.

    A call for each book would cost more than its pages, so books are dealt to buckets; a bucket's
    pages of one micro-batch are held at once.
    """
    dealt = pages.select(F.pmod(F.hash("book"), F.lit(BUCKETS)).alias("bucket"), F.col("book").isNull().alias("none"), F.coalesce("book", F.lit(0)).cast("long").alias("book"), "p", "n", "cnt", "multi")
    return dealt.groupBy("bucket").applyInPandasWithState(_skip, SKIP, "seen string", "append", GroupStateTimeout.NoTimeout)


def _stop(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    from ..functions.text import loops_at_end

    tail, chars, chunks, stopped = state.get if state.exists else ("", 0, 0, False)
    for b in batches:
        for r in b.sort_values("seq").itertuples():
            if stopped:
                continue
            tail, chars, chunks = (tail + r.chunk)[-TAIL:], chars + len(r.chunk), chunks + 1
            stopped = chunks >= 15 and loops_at_end(tail)
    state.update((tail, chars, chunks, stopped))
    yield pd.DataFrame([(key[0], chunks, stopped, chars)], columns=["page", "chunks", "stopped", "chars"])


def token_stream(chunks: DataFrame) -> DataFrame:
    """(page, chunks, stopped, chars) after each micro-batch: a page's reply ends early where its tail loops."""
    return chunks.groupBy("page").applyInPandasWithState(_stop, "page long, chunks int, stopped boolean, chars int", "tail string, chars int, chunks int, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def last_events(log: DataFrame, most: int = 300) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
