"""Names that end alike, against a scan of all names."""

import random
import re

from quirefold import plans
from quirefold.operators import assembly as A


def test_names_against_a_scan(spark):
    rnd = random.Random(2)
    stub = lambda: rnd.choice(["X_", "B_", "", "é_"]) + rnd.choice(["P1_S1", "P1_S11", "S1", "P22", "🙂P1_S1"])
    wanted = [(p, s) for p in (1, 2, 3, None) for s in {stub() for _ in range(9)}] + [(1, ""), (1, None)]
    names = sorted({(rnd.choice([1, 2, 3, None]), rnd.choice(["", "pre_", "B_"]) + stub()) for _ in range(90)}, key=str) + [(1, None), (1, "")]
    want = {}
    for page, s in wanted:
        tail = re.search(r"(P\d+.*)$", s or "")
        hits = [(1 if n == s else 2 if n.endswith(s) else 3, n) for p, n in names if p == page is not None and n and s and (n.endswith(s) or tail and n.endswith(tail[1]))]
        if hits:
            want[page, s] = min(hits, key=lambda h: (h[0], h[1].encode()))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = A.resolve(df(wanted, "page long, stub string"), df([(*n, "x") for n in names], "page long, name string, body string"))
    assert {(r.page, r.stub): (r["rank"], r.name) for r in got.select("page", "stub", "rank", "name").collect()} == want


def test_endings_are_never_broadcast(spark):
    plan = plans.QUERIES["joi_02"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan
