import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm.words import ngrams, slices, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x85\xa0!", max_size=30)), max_size=12)


@given(TEXTS, st.integers(1, 40), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_words_and_windows_are_those_of_the_pattern(texts, size, k):
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    seen: dict = {}
    rows = 0
    for lo, hi, data, offsets in slices(column, size):
        w = words(data, offsets)
        grams, first = ngrams(w, k)
        for r in range(lo, hi):
            expected = WORD.findall(texts[r] or "")
            got = w.hash[w.first[r - lo] : w.first[r - lo + 1]]
            assert len(got) == len(expected)
            windows = [tuple(expected[i : i + k]) for i in range(len(expected) - k + 1)]
            for key, value in [*zip(expected, got), *zip(windows, grams[first[r - lo] : first[r - lo + 1]])]:
                assert seen.setdefault((type(key), key), value) == value
        rows += hi - lo
    assert rows == len(texts)
    assert len(set(map(int, seen.values()))) >= len(seen) - (k == 1) * len(seen)


def test_lower_folds_ascii_alone_and_strip_takes_punctuation():
    data = np.frombuffer("ABC abc É é".encode(), np.uint8)
    h = words(data, np.array([0, len(data)]), lower=True).hash
    assert h[0] == h[1] and h[2] != h[3]
    data = np.frombuffer(b"(one), one -- 'one", np.uint8)
    assert len(set(words(data, np.array([0, len(data)]), strip=True).hash.tolist())) == 1
