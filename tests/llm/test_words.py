from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import words
from tests.llm.conftest import split_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB01 ,\n-éÉ日z\x7f", max_size=30)), max_size=8), st.integers(4, 40))
def test_words_and_grams(texts, chunk):
    old, words.CHUNK = words.CHUNK, chunk
    try:
        h, offs = words.word_hashes(pa.array(texts, pa.string()))
    finally:
        words.CHUNK = old
    split = [split_words(t) for t in texts]
    assert np.diff(offs).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    by_word = {w: int(x) for w, x in zip(flat, h)}
    assert [by_word[w] for w in flat] == h.tolist()
    assert len(set(by_word.values())) == len(by_word)
    grams, at = words.own_ngrams(h, offs, 3)
    want = [tuple(s[i : i + 3]) for s in split for i in range(len(s) - 2)]
    assert len(want) == len(grams)
    seen = {}
    for w, g in zip(want, grams.tolist()):
        assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_prefixes():
    whole = pa.array(["zero", None, "one two", "threefold three", ""], pa.string())
    h, offs, four = words.word_hashes(whole.slice(1, 3), (4,))
    assert offs.tolist() == [0, 0, 2, 4]
    assert (four == 0).tolist() == [True, True, False, False]
    assert four[2] == four[3]
    assert words.word_hashes(pa.array([], pa.string()))[1].tolist() == [0]
