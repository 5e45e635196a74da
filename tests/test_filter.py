"""The page filter with state: books of any number, over batches, by few calls."""

import random

from quirefold.plans.profiles import page_skips
from quirefold.streaming import pages as S


def test_many_books_over_batches(spark, tmp_path):
    rnd = random.Random(6)
    sizes = {b: rnd.randrange(1, 60) for b in [*range(-300, 300), 2**62, None]}
    rows = [(b, p, n, int(rnd.random() < 0.1), rnd.random() < 0.3) for b, n in sizes.items() for p in range(1, n + 1)]
    schema, inp = "book long, p int, n int, cnt int, multi boolean", str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] * 3 // (r[2] + 1) == part], schema).coalesce(1).write.mode("append").parquet(inp)
    df = spark.createDataFrame(rows, schema)
    filtered = S.page_filter(S.files(spark, inp, df.schema, 1))
    out = S.drain(filtered, str(tmp_path / "work"))
    want = page_skips(df).select("book", "p", "action")
    assert out.count() == len(rows) and out.exceptAll(want).count() == 0
    assert "bucket#" in filtered._jdf.queryExecution().analyzed().toString()  # not a call for each book
