"""Operators 1, 9 and 10: held-out accuracy, exact round trips, defined results."""

import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import chat, langid, ordinal

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out(documents, docs, none):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(documents.where(~held))
    found = langid.predict(documents, model).join(documents.where(held).select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    odd = langid.predict(docs, model)
    assert {r.lang_pred for r in odd.where("doc_id in (75, 76, 77)").collect()} == {"und"}
    assert odd.where("score < 0 or score > 1 or lang_pred is null").count() == 0 and odd.count() == docs.count()
    assert langid.predict(none, model).count() == 0


def test_language_nothing_to_learn(documents, none, docs):
    model = langid.train(none)
    assert model.langs == [] and langid.predict(docs, model).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_kneser_ney_sums_to_one():
    """Over all characters that follow a context, interpolated probabilities add up to less than one, and near it."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abc ", k=400)) for _ in range(5)]
    key, _ = langid.grams(texts)
    keys, count = np.unique(key, return_counts=True)
    m = langid.Model({"x": (keys, count)})
    context = keys >> np.uint64(16)
    for c in np.unique(context)[:20]:
        grams = (np.uint64(c) << np.uint64(16)) | np.array([ord(x) for x in "abc "], np.uint64)
        bits = -m.entropy(grams, np.arange(5))[:, 0]
        assert 0.9 < np.exp2(bits).sum() <= 1.0001


def test_kneser_ney_like_brute_force():
    rnd = random.Random(4)
    taught = {x: ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(12)] for x, letters in (("x", "abcde  "), ("y", "cdefé  "), ("z", "é漢字ab "))}
    model = langid.Model({x: np.unique(langid.grams(t)[0], return_counts=True) for x, t in taught.items()})
    probes = ["abc de", "ffé", "q", "漢字 ab", "abcdeabcde", "é é"]
    got = model.entropy(*langid.grams(probes))
    for j, x in enumerate(model.langs):
        want = [brute.kneser_ney(taught[x], p) for p in probes]
        assert got[:, j] == pytest.approx(want, abs=1e-3)


def test_prediction_whatever_the_partitions(documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = [{r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents.repartition(n), langid.train(documents.where(~held).repartition(n))).collect()} for n in (1, 7)]
    assert found[0] == found[1]


def test_empty_language_is_a_language(spark):
    rows = [("aaa aab aba", "")] * 3 + [("xyz zyx yxz", "x")] * 3 + [("qqq", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["", "x"]
    got = langid.predict(spark.createDataFrame([(1, "aab aaa"), (2, "zyx")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "", 2: "x"}


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


TEXT = st.lists(st.sampled_from(["a", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", "/", "\n", "é", "🙂", "$1", "<\\/s>"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", "[/INST]x"]), TEXT), min_size=1, max_size=6), min_size=1, max_size=30))
def test_chat_round_trip(spark, talks):
    rows = [(c, i, r, t) for c, talk in enumerate(talks) for i, (r, t) in enumerate(talk)]
    random.Random(1).shuffle(rows)
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(f).collect()}
    assert got == {c: digest(talk) for c, talk in enumerate(talks)}
    for r in chat.expand(f, materialise=True).join(f, "conv_id").collect():
        assert r.formatted.startswith(r.context + r.target + chat.CLOSE) and r.context.endswith(f"{chat.ROLE}assistant{chat.BODY}")


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "late"), (2, 0, "user", "hi"), (2, 0, "user", "hi")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.format_conversations(turns)).collect()}
    assert got == {1: digest([("", ""), ("assistant", "")]), None: digest([("user", "x")]), 2: digest([("user", "late"), ("user", "hi"), ("user", "hi")])}
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_loss_comes_from_the_examples(spark, monkeypatch):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d </s>")]
    f = chat.format_conversations(spark.createDataFrame([(1, i, *t) for i, t in enumerate(talk)], "conv_id long, turn long, role string, text string"))
    rows = chat.expand(f, materialise=True).orderBy("example").collect()
    assert [(r.example, chat.ROLE + "user" in r.context, r.context.count("assistant")) for r in rows] == [(0, True, 0 + 1), (1, True, 2)]
    assert tuple(chat.digest(f).first())[1:5] == digest(talk)
    whole = chat.expand
    monkeypatch.setattr(chat, "expand", lambda f, **k: whole(f, **k).where("example <> 0"))
    assert tuple(chat.digest(f).first())[3:5] == digest([("assistant", "d </s>")])[2:]


def test_chat_loss_needs_the_contexts(spark, monkeypatch):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d </s>"), ("user", "e")]
    f = chat.format_conversations(spark.createDataFrame([(1, i, *t) for i, t in enumerate(talk)], "conv_id long, turn long, role string, text string"))
    formatted = f.first().formatted
    rows = chat.expand(f).orderBy("example").collect()
    assert [r.context + r.target for r in rows] == [formatted[: r.target_end] for r in rows] and len(rows) == 2
    assert tuple(chat.digest(f).first())[1:5] == digest(talk)
    whole = chat.expand
    monkeypatch.setattr(chat, "expand", lambda f, **k: whole(f, **k).withColumn("context", F.lit("")))
    got = tuple(chat.digest(f).first())[1:5]
    assert got[:2] == digest(talk)[:2] and got[2:] != digest(talk)[2:]


def test_chat_long_conversation(spark):
    """Contexts are written out, one at a time, behind the explosion of spans."""
    n, body = 800, "x" * 500
    f = chat.format_conversations(spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 1, 'assistant', 'user') role", f"'{body}' text"))
    assert tuple(chat.digest(f).first())[1:5] == digest([("assistant" if i % 2 else "user", body) for i in range(n)])
    turn = [len(f"{chat.OPEN}{chat.ROLE}{r}{chat.BODY}{body}{chat.CLOSE}") for r in ("user", "assistant")]
    want = sum(k * sum(turn) + sum(turn) - len(body + chat.CLOSE) for k in range(n // 2))
    got = chat.expand(f).agg(F.count("*").alias("n"), F.sum(F.octet_length("context")).alias("size")).first()
    assert (got.n, got.size) == (n // 2, want)


def test_chat_plan_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_conversations(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ordinal_held_out(spark, docs, none):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(documents, labels.where(~aside))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    found = ordinal.grade(documents, model).join(ordinal.ratings(labels.where(aside)), "doc_id")
    n = {r.grade: r for r in found.groupBy("grade").agg(F.count("*").alias("n"), F.avg(F.col("selected").cast("int")).alias("s"), F.avg("expected_grade").alias("e")).collect()}
    assert n[2].s >= 0.97 and n[1].s <= 0.1 and n[0].s <= 0.1 and n[0].e < n[1].e < n[2].e
    assert ordinal.grade(docs, model).where("p_tail is null or p_tail < 0 or p_tail > 1").count() == 0
    assert ordinal.grade(none, model).count() == 0


def test_ordinal_sample_is_bounded(spark):
    rows = [(i, f"good words stand here {i} " * 5, 1, 0) for i in range(40)] + [(100 + i, f"B{i}*** A$$$ D%%% " * 9, 0, 0) for i in range(40)]
    rows += [(500, " ".join(f"w{k}" for k in range(30_000)), 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = df.select("doc_id", "quality", "toxic")
    models = [ordinal.train(d, y, max_train_features=n) for d, y, n in ((df, labels, 10_000), (df.where("doc_id <> 500"), labels, 10_000), (df.unionByName(df.where("doc_id = 3")), labels.union(labels), 10_000))]
    assert models[0].weights.any() and all((m.weights == models[0].weights).all() and (m.thresholds == models[0].thresholds).all() for m in models)
    assert ordinal.grade(df, models[0]).where("selected <> (doc_id < 100 or doc_id = 500)").where("doc_id <> 500").count() == 0


def test_ordinal_without_labels(docs, spark):
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels)
    assert not model.weights.any()


def test_language_model_keeps_all_grams_in_slices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole, sliced = langid.train(docs), langid.train(docs, slice_grams=9000)
    rows = docs.where("text is not null and lang is not null").select("text", "lang").collect()
    kept = {x: len(np.unique(langid.grams([r.text for r in rows if r.lang == x])[0])) for x in whole.langs}
    counts = {r[0]: r[1] for r in sliced.counts.groupBy("lang").count().collect()}
    assert counts == kept and sliced.parts > 2  # calibration rows too
    assert len(whole.orders[3]) == len(np.unique(langid.grams([r.text for r in rows])[0]))
    a, b = ({r.doc_id: r for r in langid.predict(docs, m).collect()} for m in (whole, sliced))
    assert a.keys() == b.keys() and all(a[k].lang_pred == b[k].lang_pred and a[k].rejected == b[k].rejected for k in a)
    assert all(abs((a[k].cross_entropy or 0) - (b[k].cross_entropy or 0)) < 1e-4 for k in a)
