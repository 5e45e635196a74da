"""Texts and records written to files and read back."""

import os

import pytest
from pyspark.sql import functions as F

from quirefold import plans
from quirefold.sources import files


def test_texts_round_trip(spark, tmp_path):
    rows = [("a.md", "x\ny\n"), ("007", ""), ("p=1/%.md", "ünï\n\ncode"), ("null.md", None), ("lead", "\n\nx")]
    folder = files.write_texts(spark.createDataFrame(rows, "name string, body string"), f"{tmp_path}/t")
    assert {r.name: r.body for r in files.read_texts(spark, folder).collect()} == {n: b or "" for n, b in rows}
    assert {r.name: r.length for r in files.listing(spark, folder).collect()} == {n: len((b or "").encode()) for n, b in rows}
    plan = files.listing(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q "x"', None), (2, None, 3.5)], "id long, name string, v double")
    folder = files.write_records(df, f"{tmp_path}/r")
    with open(f"{folder}/broken.json", "w") as f:
        f.write("{invalid_json: true,\n")
    got = {tuple(r) for r in files.read_records(spark, folder, df.schema).collect()}
    assert got == {(1, 'q "x"', None), (2, None, 3.5), (None, None, None)}


def test_odd_bytes_pages_and_settings(spark):
    raw = spark.createDataFrame([(b"a\xffb\xc3",), ("ü".encode(),), (None,)], "b binary")
    assert [r[0] for r in raw.select(files.whole(F.col("b").cast("string"))).collect()] == ["a�b�", "ü", None]
    page = "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] >>\n"
    texts = ["%PDF-1.4 /Type/Pages " + page * 3, "%PDF-1.4 " + page, "no header" + page * 3, "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(files.page_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 0, 0, 0, 0]  # the second is under 100 bytes
    rows = spark.createDataFrame([({"dpi": "300", "x": None},), (None,)], "m map<string,string>")
    got = rows.select(files.overlay(F.expr("map('dpi', '200', 'x', 'y', 'z', '1')"), F.col("m"))).collect()
    assert [r[0] for r in got] == [{"dpi": "300", "x": "y", "z": "1"}, {"dpi": "200", "x": "y", "z": "1"}]


def test_pruning_deletes(spark, tmp_path):
    rows = [("masked", "b/1", "xx"), ("masked", "b/2", ""), ("final", "b/1", "yyy"), ("raw", "c/1", None)]
    folder = files.write_kinds(spark.createDataFrame(rows, "kind string, name string, body string"), f"{tmp_path}/work")
    seen = lambda: {(r.kind, r.name): r.length for r in files.manifest(spark, folder).collect()}
    assert seen() == {(k, n): len(b or "") for k, n, b in rows}
    files.prune(spark, folder, ("masked", "none"))
    assert seen() == {("final", "b/1"): 3, ("raw", "c/1"): 0}
    files.prune(spark, folder, ("final", "raw"))
    assert seen() == {}


ODD = [("a.md", "x\ny\n"), ("007", ""), ("p=1/%.md", "ünï\n\ncode"), ("..", None), ("a,1", "z"), ("twice", "one"), ("twice", "two"), ("twice", "two")]


def test_one_file_each_in_folders_of_tasks(spark, tmp_path):
    df = spark.createDataFrame(ODD, "name string, body string").union(spark.range(300).selectExpr("cast(id as string)", "repeat('é', int(id))"))
    folder = files.write_texts(df, f"{tmp_path}/t")
    want = sorted((r.name, r.body or "") for r in df.collect())
    assert sorted(map(tuple, files.read_texts(spark, folder).collect())) == want
    assert sorted((r.name, r.length) for r in files.listing(spark, folder).collect()) == sorted((n, len(b.encode())) for n, b in want)
    top = os.listdir(folder)
    assert all(x.startswith("part-") for x in top) and len(top) <= 4 and sum(len(os.listdir(f"{folder}/{x}")) for x in top) == len(want)
    assert files.read_texts(spark, files.write_texts(df.limit(0), folder)).count() == 0  # written over


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.range(40).coalesce(1).selectExpr("cast(id as string) as name", "if(id = 39, raise_error('lost'), 'x') as body")
    with pytest.raises(Exception, match="lost"):
        files.write_texts(df, f"{tmp_path}/t")
    assert os.listdir(f"{tmp_path}/t") == []


def test_stores_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_mounted", lambda *_: None)
    test_texts_round_trip(spark, tmp_path)
    test_pruning_deletes(spark, tmp_path)


@pytest.mark.parametrize("name", ["src_09", "src_08", "snk_02", "snk_06", "src_10"])
def test_the_driver_sees_no_single_files(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan text" not in plan and "FileScan binaryFile" not in plan
