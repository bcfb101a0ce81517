"""The vectorised text views against plain Python, on random texts."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute

from grovetally.llm._text import chunks, shingles, spread

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab Ä\n\t é\U0001f600.", max_size=40)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 60))
def test_words_lines_and_windows(given_texts, limit):
    got_words, got_lines, got_sizes, windows = [], [], [], []
    for c in chunks(pa.array(given_texts, pa.string()), limit):
        raw = c.data.tobytes()
        starts, ends, begins = c.words()
        points = c.code_points()
        h, wb = shingles(c.span_hash(starts, ends), begins)
        ls, le, lb = c.lines()
        for d in range(c.n):
            own = range(begins[d], begins[d + 1])
            got_words.append([raw[starts[i] : ends[i]].decode() for i in own])
            got_sizes.append([int(points[ends[i]] - points[starts[i]]) for i in own])
            got_lines.append([raw[ls[i] : le[i]].decode() for i in range(lb[d], lb[d + 1])])
            windows.append([int(x) for x in h[wb[d] : wb[d + 1]]])
    plain = [t or "" for t in given_texts]
    assert got_words == [brute.words(t) for t in plain] and got_sizes == [[len(w) for w in brute.words(t)] for t in plain]
    assert got_lines == [t.split("\n") for t in plain]
    sets = [brute.shingle_set(t) for t in plain]
    assert [len(set(w)) for w in windows] == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert len(set(windows[i]) & set(windows[j])) == len(a & b)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5)), max_size=10))
def test_spread(pairs):
    first, count = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    assert list(spread(first, count)) == [f + i for f, n in pairs for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA É\n#|.!", max_size=60))
def test_rules_of_one_text(text):
    from grovetally.llm.rules import Rules, judge

    for c in chunks(pa.array([text])):
        got, fails, _ = judge(c, Rules())
        assert tuple(int(got[n][0]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.rules(text)[:5]
        assert bool(got["base_failed"][0]) == brute.rules(text)[5] and len(fails) == text.count("\n") + 1
