"""Letting executors import this package; what a session sets for its Python workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to executors, once a session, where PYTHONPATH does not lead to it."""
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in on_path or getattr(sc, "_quirefold_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "quirefold_pkg.zip")  # read by the driver's file server only
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "quirefold")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    sc._quirefold_shipped = True


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most where the session has Spark's own bound of 64 MB: every task holds several."""
    with contextlib.suppress(Exception):  # the setting is an internal one
        if spark.conf.get(_BATCH_BYTES, "64MB") in ("64MB", "67108864b", "67108864"):
            spark.conf.set(_BATCH_BYTES, "8MB")
