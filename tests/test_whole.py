"""Queries do the whole job: all rows, whole texts, ids of any length."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold import plans
from quirefold.functions import text as X

SF = "/root/testdata/sf0.001"


def test_token_stream_takes_all_and_stops_loops(spark):
    got = {r.page: r.chunks for r in plans.QUERIES["stm_06"](spark, SF).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()}
    assert {p: n for p, n in got.items() if p >= 0} == want and max(want.values()) > 40
    assert [got[-1], got[-2], got[-3]] == [15, 15, 23]


def test_token_stream_longer_than_forty(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("event_id"), F.lit(25).cast("long").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.page: r.chunks for r in plans.QUERIES["stm_06"](spark, str(tmp_path)).collect()}[25] == 100


@pytest.mark.parametrize("tail", ["word " * 10, "word " * 5, "eight ch" * 3, "line one\nline two\n" * 3, "l1\nl2\n" * 3, "short", "same line\n\n" * 3, "a\nb\nc\nd\ne\n\n" * 3, "and so on again " * 3 + "but not here"])
def test_loop_at_end_agrees_with_column(spark, tail):
    assert spark.createDataFrame([(tail,)], "x string").select(X.streaming_loop(F.col("x"))).first()[0] is X.loops_at_end(tail)


def test_books_hold_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    want = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        want.setdefault(f"{r.lang}/{r.doc_id // 100}", []).append(r.text or "")
    got = {r.book: r.text for r in plans.QUERIES["agg_02"](spark, SF).collect()}
    assert got == {b: "\n\n---\n\n".join(t) for b, t in want.items()} and sum(map(len, want.values())) == len(docs)


def stripped(text):
    """The steps one after the other, in plain Python."""
    out = re.sub(r"<think>[\s\S]*?</think>", "", text.strip()).strip()
    out = re.sub(r"\A[\s\S]*?</think>", "", out).strip()
    for mark in ("```markdown", "```md", "```"):
        if out.startswith(mark):
            out = out[len(mark) :].strip()
            break
    out = out[:-3].strip() if out.endswith("```") else out
    return X.loops_cut(out)


def test_fences_come_off_whole_texts(spark, tmp_path):
    long = "\n".join(f"line {i} of a text that goes on" for i in range(40))
    texts = [long, long + "\n" + "and this phrase again; " * 9, "# T\n" + "the same line\n" * 7, "x" * 90 + "</think>\nthe end", "short", "", None]
    rows = [(i, t, "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = ["markdown", "md", ""]
    want = {i: stripped(f"<think>src1</think>\n```{kinds[i % 3]}\n{t or ''}\n```") for i, t, _ in rows}
    assert {r.doc_id: r.body for r in plans.QUERIES["str_02"](spark, str(tmp_path)).collect()} == want
    assert want[0] == long and want[1].count("again") == 3 and want[2].count("same") == 2


def test_phrase_filter_misses_nothing(spark):
    rnd = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [None, "", "\n", "a" * 36, "ab" * 17]
    for p in range(12, 121):
        for _ in range(4):
            phrase, lead = "".join(rnd.choices("ab é漢🙂", k=p)), "".join(rnd.choices("xyz ", k=rnd.randint(0, 300)))
            texts.append(lead + phrase * rnd.choice([2, 3, 3, 5]) + lead[:7])
    got = X._cut_batch(pd.Series(texts, dtype=object)).tolist()
    assert got == [X.loops_cut(t) for t in texts]
    assert X._cut_batch(pd.Series([], dtype=object)).tolist() == []


@pytest.mark.parametrize(("name", "key"), [("img_01", "p_partkey"), ("img_05", "p_partkey"), ("oe_stages", "stub")])
def test_pages_of_all_parts(spark, name, key):
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    got = [int(r[0]) for r in plans.QUERIES[name](spark, SF).select(key).collect()]
    assert set(got) == parts and len(got) == len(parts)


def test_crops_of_pages_with_long_numbers(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "x"), (1234, 0, "user", "x"), (12345, 0, "user", "x"), (12345, 1, "user", "x"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7,), (1234,), (12345,)], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in plans.QUERIES["joi_09"](spark, str(tmp_path)).collect()}
    assert got == {(7, 1, "book_P0007_S0_staff.png"), (1234, 1, "book_P1234_S0_staff.png"), (12345, 2, "book_P12345_S0_staff.png")}
    assert {(r.page_id, r.crops_count) for r in plans.QUERIES["api_04"](spark, str(tmp_path)).collect()} == {(7, 1), (1234, 1), (12345, 2)}
