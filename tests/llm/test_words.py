import re

import numpy as np
import pyarrow as pa
from helpers import SPACED, lower
from hypothesis import given, settings
from hypothesis import strategies as st

from postflow.llm import text as tx
from postflow.llm import vbyte

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé z\t\n\x0b\x1c #9", max_size=30)), max_size=8)


def spelled(found):
    terms = found.terms.to_pylist()
    return [[terms[c] for c in found.codes[a:b]] for a, b in zip(found.offsets[:-1], found.offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    array = pa.array(texts, pa.string())
    assert spelled(tx.words(array)) == [re.findall(SPACED, t or "") for t in texts]
    assert spelled(tx.words(array, tx.ALNUM)) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]


def test_slices_keep_rows_and_bounds():
    texts = ["a" * n for n in (3, 0, 50, 1, 1, 1, 20, 9)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], ["t"]) for a, b in ((0, 4), (4, 4), (4, 9))]
    parts = list(tx.slices(batches, "t", 10))
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 10 for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_vbyte(values):
    found = vbyte.decode(*vbyte.encode(np.array(values, np.uint32)))
    assert found[: len(values)].tolist() == values and not found[len(values) :].any()


def test_hashes_tell_terms_apart():
    terms = sorted({f"{a}{b}" for a in ("", "a", "é", "x" * 70, "aa") for b in range(3000)} | {"", "a", "aa", "ab", "ba", "\x00", "\x00\x00"})
    found = tx.hashes(pa.array(terms, pa.large_string()))
    assert len(set(found.tolist())) == len(terms)
    assert (tx.hashes(pa.array(terms[5:], pa.string()).slice(3)) == found[8:]).all()
    assert len(tx.hashes(pa.array([], pa.string()))) == 0
