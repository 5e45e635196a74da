"""The phrase pass against the regular expression it stands for; batches of texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold import plans
from quirefold.functions import text as X


def loops(seed):
    rnd, out = random.Random(seed), []
    for _ in range(rnd.randint(1, 6)):
        phrase = "".join(rnd.choices(rnd.choice(["ab", "a", "abc é漢🙂", "x\ny z"]), k=rnd.choice([1, 2, 5, 11, 12, 13, 24, 36, 40, 60, 119, 120, 121])))
        n = rnd.choice([1, 2, 3, 3, 4, 7, 40])
        out += [(phrase * n)[: rnd.choice([10**9, len(phrase) * n - 1])], "".join(rnd.choices("pq \n", k=rnd.choice([0, 1, 5, 30])))]
    return "".join(out)


def test_phrases_as_by_the_expression():
    texts = [loops(k) for k in range(400)]
    for text, lengths in zip(texts, X.loop_lengths(texts), strict=True):
        assert X.phrases_cut(text, lengths) == re.sub(r"([^\n]{12,120}?)\1{2,}", r"\1\1", text)


def test_blocks_keep_order_and_nulls(spark):
    rows = [(k, None if k % 7 == 0 else loops(k)) for k in range(600)] + [(600, "the same phrase " * 40000)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", X.cut_inline_loops(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {k: t and re.sub(r"([^\n]{12,120}?)\1{2,}", r"\1\1", t) for k, t in rows}


# by finding: F12
@pytest.mark.parametrize("name", ["str_03", "str_04", "str_02"])
def test_batches_of_texts_are_small(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8MB"
