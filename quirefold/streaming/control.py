"""Start, pause, resume and stop of a stream's run, with the failed batch done again.

The state of a run is its checkpoint: a pause stops the query, going on starts it from the same
marks, and a batch that was under way comes again with the same rows and number. A sink that writes a
batch under its number is therefore whole, and has each row once, however often a run was broken.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOST = (ConnectionError, TimeoutError)


class Run:
    """One stream into one sink(batch, number). state: idle, running, paused, failed, done or stopped.

    A sink that loses its connection pauses the run; after ``wait`` seconds the same batch is tried
    again, ``retries`` times in a row at most. Any other error ends the run at once and is raised.
    """

    def __init__(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, retries: int = 3, wait: float = 0.2):
        self.stream, self.sink, self.marks, self.retries, self.wait = stream, sink, f"{folder}/marks", retries, wait
        self.state, self.error, self.done, self.log = "idle", None, 0, []
        self._query, self._awake = None, threading.Event()

    def _batch(self, batch: DataFrame, number: int) -> None:
        try:
            self.sink(batch, number)
        except BaseException as e:
            self.error = e
            raise
        self.done += 1

    def _to(self, state: str) -> None:
        self.state = state
        self.log.append(state)

    def start(self) -> Run:
        if self.state not in ("idle", "paused"):
            return self  # a second start changes nothing, and what has ended stays so
        self.error = None
        self._to("running")
        self._query = self.stream.writeStream.option("checkpointLocation", self.marks).foreachBatch(self._batch).trigger(availableNow=True).start()
        return self

    resume = start

    def _halt(self, state: str) -> None:
        if self.state in ("running", "paused"):
            if self._query is not None:
                self._query.stop()
            self._to(state)
            self._awake.set()

    def pause(self) -> None:
        if self.state == "running":
            self._halt("paused")

    def stop(self) -> None:
        self._halt("stopped")

    def join(self) -> str:
        """Wait until the run is done, or until somebody else paused or stopped it; its state."""
        left, before = self.retries, self.done
        while self.state == "running":
            try:
                self._query.awaitTermination()
            except StreamingQueryException:
                if self.state != "running":
                    break
                left = self.retries if self.done > before else left
                before = self.done
                if not isinstance(self.error, LOST) or left == 0:
                    self._to("failed")
                    raise
                left -= 1
                self._to("paused")
                self._awake.clear()
                self._awake.wait(self.wait)
                self.start()
                continue
            if self.state == "running":
                self._to("done")
        return self.state


def states(commands: DataFrame) -> DataFrame:
    """(worker, seq, cmd) to each command with the worker's state behind it: idle, running, paused or ended.

    Only a worker at rest starts and only one at work pauses or goes on; other commands change nothing.
    What comes after a shutdown is not read. A worker's commands are one ordered window.
    """
    past = Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    now = Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cmd = F.col("cmd")
    rows = commands.select("worker", "seq", "cmd").withColumn("gone", F.coalesce(F.max(cmd == "shutdown").over(past), F.lit(False))).where("NOT gone")
    rows = rows.withColumn("alive", F.coalesce(F.last(F.when(cmd.isin("start", "stop"), cmd == "start"), ignorenulls=True).over(past), F.lit(False)))
    turn = F.when(cmd == "shutdown", "ended").when(cmd == "stop", "idle").when((cmd == "start") & ~F.col("alive"), "running").when((cmd == "pause") & F.col("alive"), "paused").when((cmd == "resume") & F.col("alive"), "running")
    return rows.withColumn("turn", turn).select("worker", "seq", "cmd", F.coalesce(F.last("turn", ignorenulls=True).over(now), F.lit("idle")).alias("state"))
