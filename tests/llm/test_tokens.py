"""Operators 6 and 7 against the tokenizer library, and the packing's rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirefold.llm import packing, pretoken, token_fst

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abcdstmrevl ABC\t\n'!?.,019éüßÉİıΣς漢ひ🙂́̈​ \x85\x1c½Ⅷ<|>", "'s", "'re", "'ll", "'VE", "<|endoftext|>", "<|startoftext|>", "   "]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=5))
def test_like_the_library(texts):
    word, byte = Tokenizer.from_file(WORD) if not hasattr(test_like_the_library, "w") else test_like_the_library.w, None
    test_like_the_library.w = word
    byte = getattr(test_like_the_library, "b", None) or Tokenizer.from_file(BYTE)
    test_like_the_library.b = byte
    tokens = getattr(test_like_the_library, "t", None) or packing.Tokens(BYTE)
    test_like_the_library.t = tokens
    assert token_fst.count_tokens(texts, WORD).tolist() == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
    ids, edges = tokens.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(edges[:-1], edges[1:], strict=True)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]


def around(c):
    """A code point where each neighbour could merge with it."""
    x = chr(c)
    return f"abc{x}'ll 1{x}c {x}{x}'s\n"


def test_every_code_point(libraries):
    """Counts and ids of texts around all code points are the library's; sixteen to a text where planes are mostly empty."""
    tokens = packing.Tokens(BYTE)
    texts = [around(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(map(around, range(c, c + 16))) for c in range(0x20000, 0x110000, 16)]
    for at in range(0, len(texts), 4096):
        own = texts[at : at + 4096]
        want = [len(e.ids) for e in libraries[0].encode_batch_fast(own, add_special_tokens=False)]
        assert token_fst.count_tokens(own, WORD).tolist() == want
        ids, edges = tokens.encode(own)
        want = [e.ids for e in libraries[1].encode_batch_fast(own, add_special_tokens=False)]
        assert np.array_equal(ids, np.concatenate(want)) and np.array_equal(np.diff(edges), [len(w) for w in want])


@pytest.mark.parametrize("text", ["a \U0010ffff b", "\U0010ffff", "\U0010fffe\U0010ffff's", "\ufffe\U0010ffff \U0010ffff\U0010ffff x"])
def test_last_code_points(libraries, text):
    assert token_fst.count_tokens([text, "a"], WORD).tolist() == [len(libraries[0].encode(text).ids), 1]
    ids, edges = packing.Tokens(BYTE).encode(["b", text])
    assert ids[edges[1] :].tolist() == libraries[1].encode(text).ids


def test_transducer_chunks_and_states(monkeypatch, libraries):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ALPHABET[:-4], k=rnd.choice([0, 1, 7, 300]))) for _ in range(40)]
    want = [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk in (1, 2, 7, 64, 1 << 12):
        assert token_fst.count_tokens(texts, WORD, chunk).tolist() == want
    monkeypatch.setattr(token_fst, "MOST_STATES", 50)
    token_fst._loaded.clear()
    assert token_fst.count_tokens(texts, WORD).tolist() == want
    token_fst._loaded.clear()


def test_counts_come_from_the_composed_maps():
    """Without the composition of chunk maps, texts of several chunks are counted wrong."""
    known = token_fst.loaded(WORD)[3]
    texts = ["understanding understandably", "it's"]
    maps = pretoken.ChunkMaps(*known.normalised(texts), known.kind, chunk=4)
    ones = np.ones(len(maps.start), np.int64)
    assert maps.totals(ones).tolist() == [2, 2]
    maps.maps[:] = 0  # every chunk said to be left in the starting state: cut words count again in each chunk
    assert maps.totals(ones)[0] > 2


def test_memo_keeps_values():
    rng, memo, known = np.random.default_rng(1), pretoken.Memo(5000), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 20000, 300).astype(np.uint64))
        got = memo.get(keys, lambda new, keys=keys: [int(k) * 7 for k in keys[new]])
        assert (got == keys.astype(np.int64) * 7).all()
        if memo.full:
            memo.clear()
        assert len(memo) <= 5000


def test_token_counts(docs, none, rows, libraries):
    got = {r.doc_id: r for r in token_fst.token_counts(docs, WORD).collect()}
    for d, t in rows:
        n = len(libraries[0].encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((t or "").encode()), n > 2048)
    assert token_fst.token_counts(none, WORD).count() == 0


def test_packing(docs, none, rows, libraries):
    got = packing.pack(docs, BYTE).toPandas()
    for d, t in rows:
        ids = [*libraries[1].encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
        own = own.sort_values(["piece", "sequence_id"]).drop_duplicates("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    rule(got)
    assert len(got) >= len(rows)
    least = -(-int(got.length.sum()) // 2048)
    assert got.sequence_id.nunique() <= least + 1
    assert packing.pack(none, BYTE).count() == 0


def rule(got, size=2048):
    """Sequences are gapless from 0 and never too long."""
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= size


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1))
def test_plan_packs_everything_once(histogram):
    entries = packing.plan(histogram, 64)
    used = {}
    for shape, times in entries:
        assert times > 0 and sum(n * c for n, c in shape) <= 64
        for n, c in shape:
            used[n] = used.get(n, 0) + c * times
    assert used == histogram
    slots = packing.Slots(entries)
    seen = set()
    for n, count in histogram.items():
        sequence, offset = slots.place(np.full(count, n), np.arange(count))
        seen |= set(zip(sequence.tolist(), offset.tolist(), strict=True))
    assert len(seen) == sum(histogram.values())
