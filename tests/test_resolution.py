"""Suppression, healing and padding in one pass."""

import random

from quirefold import plans
from quirefold.operators import boxes as O


def test_one_pass_is_the_three_in_turn(spark):
    rnd = random.Random(7)
    rows = [(p, i, x := rnd.randrange(300), y := rnd.randrange(200), x + rnd.randrange(20, 200), y + rnd.randrange(10, 60), rnd.randrange(9) / 10, rnd.choice("ab")) for p in range(40) for i in range(rnd.randrange(1, 12))]
    df = spark.createDataFrame(rows, "page long, id long, x1 long, y1 long, x2 long, y2 long, conf double, cls string")
    got, want = O.resolve(df).collect(), O.pad(O.heal(O.suppress(df))).collect()
    assert sorted(got) == sorted(want) and 40 < len(got) < len(rows)


def test_boxes_go_to_python_once(spark):
    plan = plans.QUERIES["img_17"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
