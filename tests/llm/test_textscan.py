"""Hashes of spans do not depend on chunks, and cost little memory."""

import tracemalloc

import numpy as np

from quirefold.llm import textscan as T


def words_of(text, lower=False):
    data = np.frombuffer(text.encode(), np.uint8)
    return T.Words(data, np.array([0, len(data)]), T.NONBLANK, lower)


def test_long_words_and_far_places(monkeypatch):
    long = "x" * 1000 + "y" * 700
    text = f"{long} a bc {long} a bc " + "d" * 5000 + f" {long}"
    whole = words_of(text).hash
    for chunk in (8, 100, 999):
        monkeypatch.setattr(T, "CHUNK", chunk)
        monkeypatch.setattr(T, "_bytes", T._Powers(T._BYTE_BASE))
        monkeypatch.setattr(T, "_words", T._Powers(T._WORD_BASE))
        got = words_of(text)
        assert (got.hash == whole).all()
        assert got.hash[0] == got.hash[3] == got.hash[-1] and got.hash[1] == got.hash[4] != got.hash[2]
    monkeypatch.undo()
    many = words_of("a b c d e f g " * 90_000)
    _, h = many.windows(20)
    assert len(set(h.tolist())) == 7


def test_memory_of_a_long_text():
    text = "some words that go on and on " * 200_000  # 6 MB
    data = np.frombuffer(text.encode(), np.uint8)
    tracemalloc.start()
    T.Words(data, np.array([0, len(data)]), T.NONBLANK, False)
    assert tracemalloc.get_traced_memory()[1] < 20 * len(data)
    tracemalloc.stop()
