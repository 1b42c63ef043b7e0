"""Words and hashes of whole columns against Python's regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from(list("abAB é ß\t\n\r\x0b.")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    offsets, data = common.utf8_column(pa.array(texts, pa.string()))
    w = common.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[w.start[i]:w.end[i]].decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    by_word = {}
    for word, h in zip(sum(got, []), w.hash.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_are_hashed_in_pieces_like_short_ones(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)) + "x" * 9000 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = common.words(data, np.array([0, len(data)]))
    monkeypatch.setattr(common, "CHUNK", 500)
    parts = common.words(data, np.array([0, len(data)]))
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_window_hashes_depend_on_the_words_of_the_window_only():
    x = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    h = common.window_hashes(x, 3)
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(common.window_hashes(x, 8)) == 0


def test_slices_of_columns():
    col = pa.array(["zero", None, "", "three"]).slice(1)
    offsets, data = common.utf8_column(col)
    assert offsets.tolist() == [0, 0, 0, 5] and data.tobytes() == b"three"
