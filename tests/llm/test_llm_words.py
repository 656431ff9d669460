import re

import numpy as np
import pyarrow as pa

from tessera.llm import words as W


def hashes(texts, **kw):
    out = []
    for chunk in W.chunks(pa.array(texts, pa.string()), **kw):
        starts = chunk.word_starts(W.SPACES)
        found = W.segment_hashes(chunk.data, W.WORDS_LOWER, starts)
        bounds = chunk.per_text(starts)
        out += [list(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_equal_words_have_equal_hashes_wherever_they_lie():
    rng = np.random.default_rng(0)
    pool = ["a", "Ab", "été", "x" * 50, "日本", "a b", "q\x0bz"]
    texts = [" ".join(rng.choice(pool, n)) + tail for n, tail in ((0, ""), (1, ""), (7, "\n"), (300, " \t"))]
    texts += [None, "", "   ", "no" + "b" * 3]
    seen = {}
    for text, found in zip(texts, hashes(texts, limit=64)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert len(words) == len(found)
        for word, value in zip(words, found):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            assert seen.setdefault(key, value) == value
    assert len(set(seen.values())) == len(seen)


def test_texts_longer_than_a_block():
    text = "alpha beta " * (W.BLOCK // 8) + "z" * (W.BLOCK + 5) + " alpha"
    found = hashes([text, "alpha", "beta", "z" * (W.BLOCK + 5)])
    assert found[0][0] == found[0][-1] == found[1][0] and found[0][1] == found[2][0] and found[0][-2] == found[3][0]


def test_sliced_and_null_columns():
    column = pa.array(["skip", None, "a b", "", "c"], pa.string()).slice(1)
    (chunk,) = W.chunks(column)
    assert chunk.count == 4 and list(np.diff(chunk.per_text(chunk.word_starts(W.SPACES)))) == [0, 2, 0, 1]
    assert list(W.chunks(pa.array([], pa.string()))) == []


def test_windows_stay_in_their_text():
    bounds = np.array([0, 3, 3, 4, 9])
    inside = W.within(bounds, 3, 9)
    assert [i for i, ok in enumerate(inside) if ok] == [0, 4, 5, 6]
