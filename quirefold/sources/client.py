"""Model servers: which of two interfaces answers, event streams as visible text, and rates of transfers.

A server is asked once by ``asking``; everything behind it works on what was answered, as columns.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stage

# Paths of the two interfaces, marks of the event stream.
NATIVE, COMPATIBLE = "/api/v1/models", "/v1/models"
DATA, DONE = "data: ", "[DONE]"
THINK, ANSWER = "<think>", "</think>"
MODELS = "models array<struct<key: string, display_name: string>>"


def fetch_url(url: str, seconds: float = 5) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Content-Type": "application/json"}), timeout=seconds) as r:
        return r.read().decode()


def asking(fetch: Callable[[str], str] = fetch_url) -> Stage:
    """A stage from (url) to the body that each interface gave; the second is asked only where the first gave no JSON object."""

    def body(url: str) -> tuple[str | None, str | None]:
        try:
            text = fetch(url)
            if not isinstance(json.loads(text), dict):
                raise ValueError("no JSON object")
            return text, None
        except urllib.error.URLError as e:
            return None, f"Connection error to {url.removesuffix(COMPATIBLE)}: {getattr(e, 'reason', e)}"
        except Exception as e:  # noqa: BLE001
            return None, f"Failed to connect to server: {e}"

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for url in rows["url"].drop_duplicates():
            native = body(url + NATIVE)[0]
            compatible, reason = (None, None) if native is not None else body(url + COMPATIBLE)
            out.append((url, native, compatible, reason))
        return pd.DataFrame(out, columns=["url", "native", "compatible", "reason"])

    return Stage("ask", "url", "native string, compatible string, reason string", ask)


def probe(answers: DataFrame) -> DataFrame:
    """(url, native, compatible, reason) to (url, online, message, models); the native answer comes first.

    A body that is no JSON object counts as none; an object without the list has no models.
    """
    spoken = lambda c: F.json_object_keys(c).isNotNull()
    native = F.from_json("native", MODELS)["models"]
    ids = F.transform(F.from_json("compatible", "data array<struct<id: string>>")["data"], lambda d: F.struct(d["id"].alias("key"), d["id"].alias("display_name")))
    none = F.from_json(F.lit("[]"), "array<struct<key: string, display_name: string>>")
    models = F.when(spoken("native"), F.coalesce(native, none)).when(spoken("compatible"), F.coalesce(ids, none)).otherwise(none)
    out = answers.select("url", "reason", spoken("native").alias("one"), spoken("compatible").alias("two"), models.alias("models"))
    said = lambda who: F.concat(F.lit(f"{who} reachable ("), F.size("models").cast("string"), F.lit(" models available)"))
    message = F.when(F.col("one"), said("Server")).when(F.col("two"), said("VLM server")).otherwise(F.coalesce("reason", F.concat(F.lit("Connection error to "), "url")))
    return out.select("url", (F.col("one") | F.col("two")).alias("online"), message.alias("message"), "models")


def _so_far(strict: bool):
    return Window.partitionBy("reply").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)


def deltas(lines: DataFrame) -> DataFrame:
    """(reply, seq, line) of event streams to (reply, seq, delta): contents up to the end mark.

    Comments, broken JSON, reasoning and empty contents give no row. A reply is the unit of a task.
    """
    line = F.trim("line")
    payload = F.when(line.startswith(DATA), F.trim(F.substr(line, F.lit(len(DATA) + 1))))
    rows = lines.select("reply", "seq", payload.alias("payload")).where("payload IS NOT NULL")
    rows = rows.withColumn("ended", F.max(F.col("payload") == F.lit(DONE)).over(_so_far(False))).where("NOT ended")
    delta = F.get_json_object("payload", "$.choices[0].delta.content")
    return rows.select("reply", "seq", delta.alias("delta")).where("delta <> ''")


def visible(chunks: DataFrame) -> DataFrame:
    """(reply, seq, delta) without thinking passages, chunk by chunk; chunks of which nothing is left go.

    A chunk that opens a passage shows nothing, unless a passage closes before the mark; one that
    closes a passage shows what follows. Whether a chunk begins inside is the last turn before it.
    """
    opens = F.col("delta").contains(THINK)
    head = F.split_part("delta", F.lit(THINK), F.lit(1))
    rows = chunks.select("reply", "seq", "delta", opens.alias("opens"), head.alias("head"))
    closes = F.col("head").contains(ANSWER)
    turn = F.when(closes, False).when(F.col("opens"), True)
    rows = rows.withColumn("turn", turn)
    inside = F.col("opens") | F.coalesce(F.last("turn", ignorenulls=True).over(_so_far(True)), F.lit(False))
    shown = F.when(~inside, F.col("delta")).when(closes, F.substr("head", F.instr("head", ANSWER) + len(ANSWER))).otherwise("")
    return rows.select("reply", "seq", shown.alias("delta")).where("delta <> ''")


def spaced(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """The rows of a key that a reporter writes: its first, then each that is at least gap behind the last written one.

    Each choice depends on the one before, so a key's rows (the log of one transfer or worker) are
    folded as one array. Rows of equal time count as one, the least of them; a null time or key is left out.
    """
    rest = [c for c in rows.columns if c not in (key, at)]
    log = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("_at"), F.struct(at, *rest).alias("_row")))).alias("_log"))
    start = F.filter(F.slice("_log", 1, 0), lambda _: F.lit(True))
    late = lambda done, r: (F.size(done) == 0) | (r["_at"] - F.try_element_at(done, F.lit(-1))["_at"] >= gap)
    kept = F.aggregate("_log", start, lambda done, r: F.when(late(done, r), F.array_append(done, r)).otherwise(done))
    return log.select(key, F.explode(kept).alias("_r")).select(key, "_r._row.*")


def rates(samples: DataFrame, gap: float = 0.5) -> DataFrame:
    """(file, at in seconds, done, total in bytes) to (file, at, speed in MB a second, eta in seconds), at each report.

    A report comes gap seconds or more after the one before; the first sample only starts the clock.
    Without progress eta is 0.
    """
    mb = 1024 * 1024
    seen = Window.partitionBy("file").orderBy("at")
    x = spaced(samples, "file", "at", gap).withColumn("took", F.col("at") - F.lag("at").over(seen)).withColumn("got", F.col("done") - F.lag("done").over(seen))
    speed = F.when(F.col("took") > 0, F.col("got") / mb / F.col("took")).otherwise(0.0)
    x = x.where("took IS NOT NULL").withColumn("speed", speed)
    eta = F.when(F.col("speed") > 0, F.greatest(F.col("total") - F.col("done"), F.lit(0)) / (F.col("speed") * mb)).otherwise(0.0)
    return x.select("file", "at", "speed", eta.alias("eta"))


def drained_by(most: int = 50) -> Column:
    """The number of the poll that takes a message (worker, seq), of at most so many each."""
    return F.floor((F.row_number().over(Window.partitionBy("worker").orderBy("seq")) - 1) / most).cast("long")
