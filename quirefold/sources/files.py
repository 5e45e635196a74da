"""Texts and records in files of the shared folder: written, listed and read back.

One text is one file. Where the shared folder is mounted (``file:``), tasks write, list and read
their files themselves: a task's files stand in a folder ``part-<n>``, which is put in place whole
by one rename, so a lost executor leaves no half of it, and the driver sees folders only, however
many files there are. In a store that only Spark reaches, a text is a folder ``name=<its name>``
by Spark's own writer, which takes far longer and needs memory of the driver for each file.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes of what is handed on at once.
ROWS, BYTES = 1000, 4 << 20


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """By name, to a stated number of tasks: files cost time and not bytes, so small ones are not to be put into one task."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), *by)


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder's path where it is one of a mounted file system, else None."""
    store, path = _store(spark, folder)
    return path.toUri().getPath() if store.getUri().getScheme() == "file" else None


def _file_of(name: str | None) -> str:
    return "null" if name is None else "=" + quote(name, safe="")


def _name_of(file: str) -> str | None:
    return unquote(file[1:].partition(",")[0]) if file[0] == "=" else None


def _put(rows: DataFrame, root: str, *kinds: str) -> None:
    """(kinds, name, value) to one file each under root, in folders of the kinds; further files of a name have a number behind it."""

    def place(made: str, target: str) -> None:
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.rename(made, target)
        except OSError:
            if not os.path.isdir(target):
                raise
            shutil.rmtree(made)  # another attempt of this task has put it in place

    def run(batches):
        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}"
        work = f"{root}/.{part}-{context.taskAttemptId()}"
        made, again, n = {}, {}, 0
        try:
            for batch in batches:
                *keys, values = (c.to_pylist() for c in batch.columns)
                for *kind, name, value in zip(*keys, values, strict=True):
                    below = "".join(f"/{k}{_file_of(v)}" for k, v in zip(kinds, kind, strict=True))
                    if below not in made:
                        made[below] = f"{work}/{len(made)}"
                        os.makedirs(made[below])
                    file = f"{made[below]}/{_file_of(name)}"
                    while True:
                        try:
                            with open(f"{file},{again[file]}" if file in again else file, "xb") as f:
                                f.write(value)
                            break
                        except FileExistsError:
                            again[file] = again.get(file, 0) + 1
                n += len(batch)
            for below, folder in made.items():
                place(folder, f"{root}{below}/{part}")
        finally:
            shutil.rmtree(work, ignore_errors=True)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    store, path = _store(rows.sparkSession, root)
    store.delete(path, True)
    store.mkdirs(path)
    _dealt(rows, *kinds, "name").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _each(spark: SparkSession, root: str, kinds: Sequence[str], content: bool) -> DataFrame:
    """(kinds, name, body or length) of the files that _put wrote; without content none is opened."""
    folders = [((), root)]
    for k in kinds:
        folders = [((*at, _name_of(e.name.removeprefix(k))), e.path) for at, f in folders for e in os.scandir(f) if e.name.startswith(k)]
    parts = [(*at, e.path) for at, f in folders for e in os.scandir(f) if e.name.startswith("part-")]
    names = [*kinds, "name", "body" if content else "length"]
    kind = pa.schema([*((k, pa.string()) for k in (*kinds, "name")), (names[-1], pa.binary() if content else pa.int64())])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for *at, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with os.scandir(folder) as entries:
                    for e in entries:
                        if content:
                            with open(e.path, "rb") as f:
                                value = f.read()
                            held += len(value)
                        else:
                            value = e.stat().st_size
                        rows.append((*at, _name_of(e.name), value))
                        if len(rows) >= ROWS or held >= BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    found = spark.createDataFrame(parts, ", ".join(f"{k} string" for k in (*kinds, "folder"))).repartition(max(1, min(len(parts), 8 * spark.sparkContext.defaultParallelism)))
    return found.mapInArrow(run, ", ".join([*(f"{k} string" for k in (*kinds, "name")), "body binary" if content else "length long"]))


def write_texts(texts: DataFrame, folder: str) -> str:
    """(name, body) to one file each; a null body is an empty file, of several bodies of a name each is a file."""
    name, body = F.col("name").cast("string").alias("name"), F.coalesce(F.col("body"), F.lit(""))
    if root := _mounted(texts.sparkSession, folder):
        _put(texts.select(name, body.cast("binary").alias("value")), root)
    else:  # the writer ends a text with one line break, which reading takes off
        _dealt(texts.select(body.alias("value"), name), "name").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("name").text(folder)
    return folder


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, body) of the whole files, bytes as they are."""
    if root := _mounted(spark, folder):
        return _each(spark, root, (), True).select("name", F.col("body").cast("string").alias("body"))
    files = spark.read.schema("value string, name string").text(folder, wholetext=True)
    return files.select("name", F.regexp_replace("value", r"\n\z", "").alias("body"))


def _entries(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """(keys, length in bytes) of files in folders named by keys, from the folders' entries alone: no content is read.

    A folder without any such entry has no columns of keys that the reader could find; it gives no rows.
    """
    if root := _mounted(spark, folder):
        return _each(spark, root, keys[:-1], False)
    store, path = _store(spark, folder)
    entries, found = store.listStatusIterator(path), False
    while not found and entries.hasNext():  # ends at the first named folder; marks of the writer stand beside them
        found = entries.next().getPath().getName().startswith(f"{keys[0]}=")
    named = "".join(f", {k} string" for k in keys)
    if not found:
        return spark.createDataFrame([], "length long" + named).select(*keys, "length")
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary" + named).load(folder)
    return files.select(*keys, (F.col("length") - 1).alias("length"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length in bytes) of the files that write_texts wrote."""
    return _entries(spark, folder, "name")


def write_records(rows: DataFrame, folder: str) -> str:
    rows.write.mode("overwrite").json(folder)
    return folder


def read_records(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Records of JSON lines; a line that is none reads as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)


def whole(body: Column) -> Column:
    """A text with the replacement mark for each ill-formed sequence of bytes."""
    return F.make_valid_utf8(body)


def page_count(body: Column) -> Column:
    """Pages of a PDF as its plain page objects say; 0 for under 100 bytes and for what has no PDF header."""
    pages = F.regexp_count(body, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return F.when((F.octet_length(body) >= 100) & body.startswith("%PDF-"), pages).otherwise(0)


def overlay(defaults: Column, given: Column) -> Column:
    """A map of settings: what is given outweighs the defaults, keys of either side stay; null or broken settings give the defaults."""
    return F.map_zip_with(defaults, F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def write_kinds(rows: DataFrame, folder: str) -> str:
    """(kind, name, body) to files below a folder of each kind."""
    kind, name, body = F.col("kind").cast("string").alias("kind"), F.col("name").cast("string").alias("name"), F.coalesce(F.col("body"), F.lit(""))
    if root := _mounted(rows.sparkSession, folder):
        _put(rows.select(kind, name, body.cast("binary").alias("value")), root, "kind")
        return folder
    _dealt(rows.select(body.alias("value"), kind, name), "kind", "name").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("kind", "name").text(folder)
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name, length in bytes) of the files that write_kinds wrote and that are left."""
    return _entries(spark, folder, "kind", "name")


def prune(spark: SparkSession, folder: str, kinds: Sequence[str]) -> None:
    """Delete the folders of the kinds, each by one call to the file system; one that is not there is passed over."""
    mounted = _mounted(spark, folder)
    for kind in kinds:
        store, path = _store(spark, f"{folder}/kind{_file_of(kind) if mounted else f'={kind}'}")
        store.delete(path, True)
