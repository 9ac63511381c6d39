import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm import text_kernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAb \t\n\x0b\x0c\rß é🙂", max_size=30)), max_size=8)


def plain_words(text):
    return (text or "").encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_hashes_equal_exactly_where_words_do(texts):
    hashes, offsets = tk.word_hashes(pa.array(texts, pa.string()))
    words = [w for t in texts for w in plain_words(t)]
    assert np.diff(offsets).tolist() == [len(plain_words(t)) for t in texts]
    of = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles_are_windows_or_the_whole_of_a_short_text(texts):
    words, offsets = tk.word_hashes(pa.array(texts, pa.string()))
    hashes, to = tk.shingles(words, offsets, 3)
    of = {}
    for i, t in enumerate(texts):
        w = plain_words(t)
        own = [tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        assert to[i + 1] - to[i] == len(own)
        for s, h in zip(own, hashes[to[i] : to[i + 1]].tolist(), strict=True):
            assert of.setdefault(s, h) == h
    assert len(set(of.values())) == len(of)


def test_values_longer_than_a_piece_and_slices(monkeypatch):
    monkeypatch.setattr(tk, "_PIECE", 64)
    texts = ["a b " * 50, "x", "", "c d e " * 40]
    full, offsets = tk.word_hashes(pa.array(texts))
    monkeypatch.undo()
    again, again_offsets = tk.word_hashes(pa.array(["skip", *texts]).slice(1))
    assert (full == again).all() and (offsets == again_offsets).all()
