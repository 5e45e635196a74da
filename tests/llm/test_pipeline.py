"""Each stage of the pipeline against brute force on its own input."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import line_crf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert len(corpus_pipeline.STAGES) == 5


def test_quality(spark, stages):
    failed = {r[0] for r in brute.rules(pairs(stages[0])) if r[-1]}
    kept = {d for d, _ in pairs(stages[1])}
    assert not kept & failed
    model = line_crf.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in line_crf.quality(stages[0], model).where("kept").collect()}


def test_near(stages):
    docs = pairs(stages[1])
    assert {d for d, _ in pairs(stages[2])} == {n[0] for n in brute.near(docs)}


def test_repeats(stages):
    want = {r[0]: r for r in brute.repeats(pairs(stages[2]))}
    got = pairs(stages[3])
    assert {d for d, _ in got} == {d for d, r in want.items() if not r[2] or r[2] < r[1]}
    assert all(brute.sha(" ".join(brute.NONBLANK.findall(t))) == want[d][3] for d, t in got)
    assert stages[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_clean(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination(pairs(stages[3]), items) if r[-1]}
    assert {d for d, _ in pairs(stages[4])} == {d for d, _ in pairs(stages[3])} - dirty


def test_packed(spark, stages):
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def _folder(path, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, docs, rows, bench_rows, tmp_path_factory):
    """The odd rows of conftest, with columns named like those that the stages use inside."""
    for name in ("row_key_", "one", "nth", "n_words_", "doc", "out", "quality"):
        docs = docs.withColumn(name, F.lit(-9))
    labels = spark.createDataFrame([(d, int(len(t or "") > 200), 0) for d, t in rows], "doc_id long, quality int, toxic int")
    return _folder(tmp_path_factory.mktemp("odd") / "sf", docs, labels, spark.createDataFrame(bench_rows, "item_id long, text string"))


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names: every stage like brute force on its input."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, before, odd).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == columns
        assert after.where("n_words <> -1 or n_removed <> -5 or row_key <> -2 or n_words_ <> -9 or one <> -9 or nth <> -9 or quality <> -9").count() == 0
        own = [(r.doc_id, r.text) for r in before.collect()]
        kept = [(r.doc_id, r.text) for r in after.collect()]
        if k == 0:
            assert not {t for _, t in kept} & {t for (_, t), r in zip(own, brute.rules(own), strict=True) if r[-1]} and kept
        if k == 1:
            assert len(kept) == len({n[0] for n in brute.near(own)})
        if k == 2:
            want = [r for r in brute.repeats(own) if not r[2] or r[2] < r[1]]
            assert sorted(brute.sha(" ".join(brute.NONBLANK.findall(t))) for _, t in kept) == sorted(r[3] for r in want)
        if k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
            assert len(kept) == sum(not r[-1] for r in brute.contamination(own, items))
        before = after
    assert corpus_pipeline.run(spark, odd).select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_empty_tables(spark, odd, tmp_path):
    docs, labels, bench = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    assert corpus_pipeline.run(spark, _folder(tmp_path / "none", docs.where("false"), labels.where("false"), bench.where("false"))).count() == 0
    assert corpus_pipeline.run(spark, _folder(tmp_path / "bare", docs, labels.where("false"), bench.where("false"))).count() > 0
