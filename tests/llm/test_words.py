import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.words import NOT_ALNUM, SPACE, Alphabet, Words, buffers, slices, windows
from tests.llm.helpers import WORD, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB9é \n\t,|\x0b名"), max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_match_the_pattern(texts, block):
    raw, offsets = buffers(pa.array(texts, pa.string()))
    w = Words(raw, offsets, Alphabet(SPACE, lower=False), places=True, block=block)
    want = [x for t in texts for x in WORD.findall(t or "")]
    assert [raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == want
    assert list(w.counts) == [len(WORD.findall(t or "")) for t in texts]
    known = {}
    for h, x in zip(w.hashes.tolist(), want):
        assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lower_case_and_alphanumerics(texts):
    raw, offsets = buffers(pa.array(texts, pa.string()))
    w = Words(raw, offsets, Alphabet(NOT_ALNUM, lower=True))
    want = [x for t in texts for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))]
    assert len(w.hashes) == len(want)
    again = buffers(pa.array([" ".join(want)]))
    assert list(Words(*again, Alphabet(NOT_ALNUM, lower=True)).hashes) == list(w.hashes)


def test_sliced_columns_and_slices():
    column = pa.array(["skipped", "a b", None, "c", "d e f"])[1:]
    raw, offsets = buffers(column)
    assert len(Words(raw, offsets, Alphabet(SPACE, False)).hashes) == 6
    assert list(slices(offsets, 3)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices(np.zeros(1, np.int64))) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 35])
def test_windows(n):
    x = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    seen = {}
    for i, h in enumerate(windows(x, n).tolist()):
        assert seen.setdefault(tuple(x[i : i + n]), h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(windows(x[: n - 1], n)) == 0
