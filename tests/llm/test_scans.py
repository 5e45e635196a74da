"""Operators 2, 3 and 5 against brute force."""

import brute
import numpy as np
import pytest

from quirefold.llm import decontam, license_scan, line_crf


def same(df, columns, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def bench(spark, bench_rows):
    return spark.createDataFrame(bench_rows, "item_id long, text string")


@pytest.mark.parametrize("slice_words", [2_000_000, 40])
def test_decontamination(docs, bench, rows, bench_rows, slice_words):
    found = decontam.contamination(docs, bench, slice_words=slice_words)
    same(found, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute.contamination(rows, bench_rows))
    kept = decontam.keep_clean(docs, bench, slice_words=slice_words)
    assert kept.columns == docs.columns
    dirty = sum(r[-1] for r in brute.contamination(rows, bench_rows))
    assert 0 < dirty and kept.count() == len(rows) - dirty


def test_decontamination_empty(none, docs, bench, spark):
    assert decontam.contamination(none, bench).count() == 0
    clean = decontam.contamination(docs, spark.createDataFrame([], bench.schema))
    assert clean.where("contaminated or n_hit > 0").count() == 0


def test_license_base_is_exact(docs, rows):
    found = license_scan.scan_licenses(docs)
    same(found, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], brute.base_phrases(rows, license_scan.BASE))
    r = found.where("doc_id = 84").first()
    assert r.labels == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,reserved" and 0.5 <= r.score <= 1
    assert found.where("labels = ''").where("score <> 0").count() == 0


def test_license_templates_match_themselves(spark):
    texts = [(i, f"Some words before. {passage.upper()}; and words behind") for i, (_, _, passage) in enumerate(license_scan.TEMPLATES)]
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[i].labels.split(",") and found[i].score == pytest.approx(1.0)


def _licence_files():
    """Whole, cut, changed and mixed passages among other words."""
    import random

    rnd, out = random.Random(11), []
    for i in range(160):
        label, key, passage = rnd.choice(license_scan.TEMPLATES)
        words = passage.split()
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(["the", "software", "other", "license", "of"])
        if rnd.random() < 0.3:
            words = words[rnd.randrange(len(words)) :]
        if rnd.random() < 0.2:
            words.insert(rnd.randrange(len(words) + 1), "new")
        if rnd.random() < 0.2:
            words += rnd.choice(license_scan.TEMPLATES)[2].split()
        lead = rnd.choices("some other words of the text are by all here license copy".split(), k=rnd.choice([0, 0, 5, 40]))
        out.append((i, " ".join(lead + words)))
    return [*out, (900, None), (901, ""), (902, "plain words alone")]


@pytest.mark.parametrize("top_words", [8, 3])
def test_license_matches_like_brute_force(spark, top_words):
    rows = _licence_files()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = license_scan.rarity(docs)
    n = len(rows)
    df = {x: sum(x in set(brute.ALNUM.findall(brute.low(t))) for _, t in rows) for x in idf}
    assert all(idf[x] == pytest.approx(np.log((1 + n) / (1 + df[x])) + 1) for x in idf)
    want = brute.licences(rows, idf, license_scan.BASE, license_scan.TEMPLATES, top_words)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, top_words=top_words).collect()}
    assert sum(bool(x) for x, _ in want) > 60 and sum(not x for x, _ in want) > 10
    for (d, _), (labels, score) in zip(rows, want, strict=True):
        assert got[d].labels == labels and got[d].score == pytest.approx(score), d


def test_license_postings_decide(spark):
    """Without rare words no template is found; a changed key phrase rejects a passage that is there otherwise."""
    label, key, passage = next(t for t in license_scan.TEMPLATES if t[0] == "zlib")
    docs = spark.createDataFrame([(1, passage), (2, passage.replace("plainly marked", "clearly marked"))], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_licenses(docs).collect()} == {1: "zlib", 2: ""}
    assert license_scan.scan_licenses(docs, top_words=0).where("labels <> ''").count() == 0


def test_license_empty(none):
    assert license_scan.scan_licenses(none).count() == 0


def test_quality_base_rules(docs, rows):
    model = line_crf.Model(list(line_crf.PRIOR.values()), line_crf.PRIOR_CHAIN)
    found = line_crf.quality(docs, model)
    same(found, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], brute.rules(rows))
    assert found.where("kept and base_failed").count() == 0
    kept = line_crf.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


def test_viterbi_is_the_best_path(spark):
    import itertools

    from quirefold.llm import textscan as T

    text = "Some plain words stand here.\nBUY!! NOW!! ***\n| a | b | c |\nplain words again and a full stop.\n\n$$$ $$$\nthe end"
    data = np.frombuffer(text.encode(), np.uint8)
    page = line_crf.Page(data, np.array([0, len(data)]))
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = line_crf.Model(rng.normal(size=len(line_crf.FEATURES)), rng.normal(size=(2, 2)))
        gain = page.features @ m.weights
        best = max(itertools.product((0, 1), repeat=len(gain)), key=lambda y: sum(g for g, l in zip(gain, y, strict=True) if l) + sum(m.chain[a][b] for a, b in zip(y, y[1:], strict=False)))
        assert m.decode(page).tolist() == list(best)


def test_crf_learns_from_labels(spark):
    good = [(i, "\n".join(["Plain words make up a line of this text and end well."] * 1 + [f"Line {i} {k} has words {k}{i} to read, as {i}x{k} says." for k in range(6)]), 1) for i in range(40)]
    bad = [(100 + i, "\n".join(f"W{k}*** O{i}$$$ R%%% D&&& S### " * 2 for k in range(7)), 0) for i in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = line_crf.train(df.drop("quality"), df.select("doc_id", "quality"))
    found = line_crf.quality(df, model).join(df.select("doc_id", "quality"), "doc_id")
    assert found.where("kept <> (quality = 1)").count() == 0
    none = line_crf.train(df.drop("quality"), df.select("doc_id", "quality").where("false"))
    assert none.weights.tolist() == list(line_crf.PRIOR.values())


def _shapes(text):
    from quirefold.llm import textscan as T

    data = np.frombuffer(text.encode(), np.uint8)
    return line_crf.Page(data, np.array([0, len(data)]))


def _plain(i, k):
    return f"Line {i} {k} has words enough to read, as {i}x{k} says to all who come by."


def test_mixed_documents_are_labelled_in_part(spark):
    """Boilerplate lines planted in good documents, and content in bad ones, are told apart; content share follows."""
    menu = "Home | About | $$$ SALE $$$ | *** | Contact"
    good = [(i, "\n".join(_plain(i, k) for k in range(8)), 1) for i in range(40)]
    bad = [(100 + i, "\n".join([menu] * 6), 0) for i in range(40)]
    planted = [(200 + i, "\n".join([menu, *(_plain(i, k) for k in range(6)), menu]), 1) for i in range(10)]
    half = [(300 + i, "\n".join([*[menu] * 6, _plain(i, 0), _plain(i, 1)]), 0) for i in range(10)]
    df = spark.createDataFrame(good + bad + planted + half, "doc_id long, text string, quality int")
    model = line_crf.train(df.drop("quality"), df.select("doc_id", "quality"))
    found = {r.doc_id: list(r.line_labels) for r in line_crf.quality(df, model).collect()}
    shares = {r.doc_id: r.content_share for r in line_crf.quality(df, model).collect()}
    assert all(found[d] == [0] * 8 for d, *_ in good) and all(found[d] == [1] * 6 for d, *_ in bad)
    assert all(found[d] == [1, *[0] * 6, 1] for d, *_ in planted) and all(0 < shares[d] < 1 for d, *_ in planted)
    assert all(found[d] == [*[1] * 6, 0, 0] for d, *_ in half)


def test_very_long_labelled_document(spark):
    """A labelled document of 100 000 lines trains in bounded memory; one that exceeds the bound is left out."""
    import tracemalloc

    good = [(i, "\n".join(_plain(i, k) for k in range(6)), 1) for i in range(30)]
    bad = [(100 + i, "\n".join(["W*** O$$$ R%%% D&&&"] * 6), 0) for i in range(30)]
    long = [(500, "\n".join(_plain(7, k % 900) for k in range(100_000)), 1)]
    df = spark.createDataFrame(good + bad + long, "doc_id long, text string, quality int")
    model = line_crf.train(df.drop("quality"), df.select("doc_id", "quality"), max_train_lines=150_000)
    less = line_crf.train(df.drop("quality"), df.select("doc_id", "quality"), max_train_lines=50_000)
    for m in (model, less):
        assert m.decode(_shapes(good[0][1])).tolist() == [0] * 6 and m.decode(_shapes(bad[0][1])).tolist() == [1] * 6
    shaped = [(_shapes(t).features, 1 - q) for _, t, q in good + bad + long]
    tracemalloc.start()
    line_crf.fit(shaped, steps=2)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, "\n".join(_plain(i, k) for k in range(6)), 1) for i in range(20)] + [(100 + i, "W*** O$$$ R%%%\n" * 6, 0) for i in range(20)]
    once = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    often = once.unionByName(once.where("doc_id = 3")).unionByName(once.where("doc_id = 3"))
    labels = once.select("doc_id", "quality")
    a, b = line_crf.train(once.drop("quality"), labels), line_crf.train(often.drop("quality"), labels)
    assert (a.weights == b.weights).all() and a.chain == b.chain
