"""What the operators share: scratch tables, Arrow maps and packed exchanges."""

from __future__ import annotations

import contextlib
import ctypes
import io
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, ship

#: What workers keep from task to task, by owner: a function that lets go of it.
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    _held[owner] = clear


def _trim() -> None:
    """Give freed memory back to the system: workers live on between tasks and operators."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


class _Task:
    """Runs a map function; first lets go of what other operators keep in this worker."""

    def __init__(self, fn, owner: str | None):
        self.fn, self.owner = fn, owner

    def __call__(self, batches):
        for owner in [o for o in _held if o != self.owner]:
            _held.pop(owner)()
        _trim()
        yield from self.fn(batches)
        _trim()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str | None = None) -> DataFrame:
    """owner: whose kept things the function uses (see hold)."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(_Task(fn, owner), schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    found = sc._jsc.sc().getCheckpointDir()
    if named:
        if not found.isDefined():
            sc.setCheckpointDir(named)
        return named
    if found.isDefined():
        return found.get()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))  # one machine, one process
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def collected_within(rows: DataFrame, doc_id: str, label: str, size: str, most: int) -> list:
    """Rows of a bounded sample, one for each (doc_id, label), on the driver: in hash order of ids, one that no longer fits ``most`` is left out."""
    table = stored(rows, "sample")
    spark, chosen, used = rows.sparkSession, [], 0
    for r in table.select(F.xxhash64(doc_id).alias("h"), doc_id, label, size).orderBy("h", doc_id, label).collect():
        if used + r[size] <= most:
            chosen, used = [*chosen, (r[doc_id], r[label])], used + r[size]
    kept = spark.createDataFrame(chosen, table.select(doc_id, label).schema)
    out = table.join(F.broadcast(kept), [doc_id, label], "left_semi").collect()
    dropped(table)
    return out


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that are taken (in any case: Spark does not tell them apart)."""
    out, used = [], {x.lower() for x in taken}
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue()


def from_ipc(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def put(batch: pa.RecordBatch, arrays: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in schema], schema=schema)
