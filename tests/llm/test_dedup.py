"""Operators 4 and 8 against brute force."""

import brute
import numpy as np

from quirefold.llm import ngram_join, substring_dedup


def key(r):
    return tuple((x is not None, x) for x in r)


def test_substring_dedup(docs, rows):
    got = [tuple(r) for r in substring_dedup.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = brute.repeats(rows)
    assert sum(r[2] > 0 for r in want) > 10
    assert sorted(got, key=key) == sorted(want, key=key)


def test_substring_dedup_small_units(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", (500, 500))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", (2000, 2000))
    got = [tuple(r) for r in substring_dedup.repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(brute.repeats(rows), key=key)


def test_remove_repeats_rewrites(docs, rows):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_words_", "n_removed_"]  # the input's own columns of these names stay
    assert out.where("n_words <> -1 or n_removed <> -5").count() == 0
    want = brute.repeats(rows)
    assert out.count() == sum(not (r[2] and r[2] == r[1]) for r in want)
    whole = {r[0]: r for r in want}
    for r in out.where("doc_id is not null and doc_id <> 79").collect():
        assert brute.sha(" ".join(brute.NONBLANK.findall(r.text or ""))) == whole[r.doc_id][3]
        assert (r.n_words_, r.n_removed_) == whole[r.doc_id][1:3]


def test_passages_are_the_maximal_repeats(docs, rows):
    got = sorted((r.doc_id, r.first_word, r.n_words) for r in substring_dedup.passages(docs).where("doc_id is not null and doc_id <> 79").collect())
    want = []
    for (d, n, *_), gone in zip(brute.repeats(rows), brute.removed_words(rows), strict=True):
        if d is not None and d != 79:
            begin = [i for i in sorted(gone) if i - 1 not in gone]
            want += [(d, i, next(j for j in range(i, n + 1) if j not in gone) - i) for i in begin]
    assert got == sorted(want) and all(n >= 20 for *_, n in got)


def test_windows_are_compared_by_their_words():
    """Windows of different words whose hashes collide are told apart."""
    rng = np.random.default_rng(5)
    words = np.concatenate([np.tile(rng.integers(0, 3, 24), 6), rng.integers(0, 2, 400)]).astype(np.uint64)
    at = np.arange(len(words) - 19)
    doc, start = at // 50, at
    first = substring_dedup.earliest((words[at] % 2).astype(np.uint64), doc, start, at, words)
    seen = {}
    for i in at.tolist():
        assert first[i] == seen.setdefault(words[i : i + 20].tobytes(), i)
    assert len(set(first.tolist())) < len(at)


def test_repeats_need_the_seeds(docs, monkeypatch):
    """Without the stretches of anchors nothing is found."""
    whole = substring_dedup.Unit.candidates
    monkeypatch.setattr(substring_dedup.Unit, "candidates", lambda self, again: whole(self, again & False))
    assert substring_dedup.UNIT_BYTES and substring_dedup._ramp(np.array([2, 0, 3])).tolist() == [0, 1, 0, 1, 2]
    unit = substring_dedup.Unit(_batch(["a b c d e f g h i j k l m n o p q r s t u v " * 2]), "doc_id", "text")
    unit.candidates(unit.own_again)
    assert not len(unit.window)
    monkeypatch.undo()
    unit.candidates(unit.own_again)
    assert len(unit.window) and unit.stretch_bytes()[0].tobytes().startswith(b"a b ")


def test_buckets_are_even():
    rng = np.random.default_rng(3)
    unit = substring_dedup.Unit(_batch([" ".join(map(str, rng.integers(0, 10**9, 40_000)))]), "doc_id", "text")
    size = np.diff(substring_dedup._bucket_edges(unit.anchors, 20))
    assert size.max() < 1.2 * size.mean() and size.min() > 0.8 * size.mean()


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def test_substring_dedup_empty(none):
    assert substring_dedup.repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_near_duplicates(docs, rows):
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_linked_texts").collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute.near(rows), strict=True)]
    # a group or class without any id is named null, by brute force as here; wordless rows by their own id
    assert sorted(got, key=key) == sorted(want, key=key)


def test_blocks_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_linked_texts").collect()]
    assert sorted(got, key=key) == sorted([(d, *x) for (d, _), x in zip(rows, brute.near(rows), strict=True)], key=key)


def test_keep_one(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    near = brute.near(rows)
    wordless = sum(not brute.ALNUM.findall(brute.low(t)) for _, t in rows)
    groups = {n[0] for n, (_, t) in zip(near, rows, strict=True) if brute.ALNUM.findall(brute.low(t))}
    assert kept.count() == len(groups) + wordless
    assert {r.doc_id for r in kept.collect()} >= groups


def test_empty(none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0


def test_bands_reach_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= ngram_join.MOST_HASHES


def test_shared_counts():
    rng = np.random.default_rng(3)
    grams = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(25)]
    got = ngram_join.shared_counts(grams)
    assert all(got[i, j] == len(np.intersect1d(grams[i], grams[j])) for i in range(25) for j in range(25))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (3, 3)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_recall_over_all_pairs(spark):
    """Of the links at 0.8 between every 50th document and all others on sf0.1, nine tenths at least are counted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    own = brute.shingle_sets(rows)
    by_gram = {}
    for i, grams in enumerate(own):
        for g in grams:
            by_gram.setdefault(g, []).append(i)
    want = {}
    for i, (d, _) in enumerate(rows):
        if d % 50 == 0:
            common = brute.Counter(j for g in own[i] for j in by_gram[g] if j != i)
            want[d] = sum(n >= 0.8 * (len(own[i]) + len(own[j]) - n) - 1e-9 for j, n in common.items())
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).where("doc_id % 50 = 0").collect()}
    assert all(got[d] <= n for d, n in want.items())
    assert sum(want.values()) == 72  # what brute force finds there
    assert sum(got.values()) >= 0.9 * 72
