"""Rounding and progress against the SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold import plans
from quirefold.functions import rounding as R


def test_rounding_as_in_sql(spark):
    rnd = random.Random(4)
    values = [(n + 0.5) / 10**p for p in (1, 4) for n in range(3000)] + [30.0 * a / t + 40.0 * b / t for t in range(1, 40) for a in range(t + 1) for b in (0, a)]
    values += [s * rnd.random() * 10 ** rnd.randrange(-3, 12) for s in (1, -1) for _ in range(3000)] + [0.0, 1e16, 1e308, float("inf"), None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(f(F.col("x"), p) for p in (0, 1, 4) for f in (R.round_half, R.round_even))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    want = con.execute("SELECT x, round(x, 0), round_even(x, 0), round(x, 1), round_even(x, 1), round(x, 4), round_even(x, 4) FROM t").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# by finding: F9
@pytest.mark.parametrize("name", ["agg_04"])
def test_progress_as_in_sql(spark, tmp_path, name):
    rnd = random.Random(9)
    rows = [(b if b != 77 else None, rnd.choice("FFFPO"), rnd.random() * 3e5) for b in range(-1500, 2500) for _ in range(rnd.randrange(1, 60))]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(plans.ORACLE[name]).fetchall()
    got = [tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
