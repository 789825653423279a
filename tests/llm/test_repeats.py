import random

import numpy as np
import pytest
from helpers import dedup_bytes, dedup_words

from postflow.llm import repeats, suffixes, trees


def check_words(docs, rows, window):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in trees.dedup_words(docs, window=window).collect()}
    assert found == dedup_words(rows, window)


def check_bytes(docs, rows, window):
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.dedup_bytes(docs, window=window).collect()}
    assert found == dedup_bytes(rows, window)


@pytest.mark.parametrize("window", [35, 9])
def test_words(table, prose, window):
    check_words(table(prose), prose, window)


@pytest.mark.parametrize("window", [100, 24])
def test_bytes(table, prose, window):
    check_bytes(table(prose), prose, window)


def test_hot_anchors_give_the_same(table, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_CONTENTS", 3)
    monkeypatch.setattr(repeats, "SOLVE_BYTES", 500)
    assert len(repeats._hot_anchors(table(prose).selectExpr("doc_id as id", "xxhash64(text) as mark", "text"), trees._kind(35)))
    check_words(table(prose), prose, 35)
    check_bytes(table(prose), prose, 100)


def test_small_settling(table, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SETTLE_BYTES", 10)
    check_words(table(prose), prose, 35)
    check_bytes(table(prose), prose, 100)


def test_one_common_line_in_different_surroundings(table):
    rng = random.Random(1)
    line = "this line of license text stands in every document of the corpus and is shared by all of them"
    rows = [(i, " ".join(str(rng.random()) for _ in range(20)) + f" {line} " + " ".join(str(rng.random()) for _ in range(20))) for i in range(80)]
    check_bytes(table(rows), rows, 60)
    check_words(table(rows), rows, 12)


def test_rows_without_id_and_repeated_rows(table, prose):
    text = prose[7][1] or "x " * 90
    found = suffixes.dedup_bytes(table([(1, text), (1, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == sorted([(1, 0), (1, 0), (0, 0), (0, 0)]) or len(text) > 100
    assert all(r.n_removed == 0 for r in found if r.doc_id is None)
    assert trees.dedup_words(table([])).count() == suffixes.dedup_bytes(table([])).count() == 0


def test_other_columns_ride_along(table, prose):
    found = suffixes.dedup_bytes(table(prose), keep=("content", "score", "rest")).first()
    assert found.rest.c1 == 0.5 and found.rest.c2 == "z"


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    begin = np.sort(rng.choice(2900, 400, replace=False))
    end = np.minimum(begin + rng.integers(1, 80, 400), 3000)
    group = np.sort(rng.integers(0, 12, 400))
    text = suffixes.Hashed(data, 911_382_323)
    order = suffixes.sort_suffixes(text, begin, end, group)
    key = lambda i: (group[i], data[begin[i] : end[i]].tobytes(), i)
    assert order.tolist() == sorted(range(400), key=key)


def test_a_wrong_hash_is_noticed(monkeypatch):
    """With a tiny prime hashes collide all the time; the result is right or the base is changed."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 4000).astype(np.uint8))
    chunks = [text[k : k + 40] for k in range(0, 4000, 40)]
    want = suffixes.solve(np.zeros(100, np.int64), chunks, np.full(100, 10), np.full(100, 11), None, window=30)
    monkeypatch.setattr(suffixes, "_PRIME", 65_537)
    got = suffixes.solve(np.zeros(100, np.int64), chunks, np.full(100, 10), np.full(100, 11), None, window=30)
    assert (want == got).all()


def test_suffix_tree_levels():
    symbols = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    found = trees.levels(symbols, np.array([0, 3, 6]), np.array([3, 6, 9]), np.zeros(3, np.int64), 3)
    assert found[2][0] == found[2][1] == found[2][2] >= 0
    assert found[3][0] == found[3][2] >= 0 and found[3][1] == -1


def test_texts_of_one_id_are_apart(table):
    """A text that occurs once stays whole, whatever other texts share its id."""
    a, b = (" ".join(f"{x}{k}" for k in range(45)) for x in "ab")
    rows = [(2, a), (2, b), (1, a), (2, a)]
    found = sorted((r.doc_id, r.kept) for r in trees.dedup_words(table(rows)).collect())
    assert found == [(1, ""), (2, ""), (2, ""), (2, b)]
    found = sorted((r.doc_id, bytes(r.kept).decode()) for r in suffixes.dedup_bytes(table(rows)).collect())
    assert found == [(1, a), (2, ""), (2, ""), (2, b)]


def test_a_text_of_many_megabytes(table):
    """One text of 12 MB, with a passage that another one has too."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 40, 1_000_000).tolist()
    long = " ".join(map(str, words))
    passage = " ".join(map(str, words[500_000:500_040]))
    found = {r.doc_id: r.n_removed for r in suffixes.dedup_bytes(table([(1, long), (2, "x " + passage + " y")])).collect()}
    assert found[1] == 0 and len(passage) <= found[2] <= len(passage) + 2
    found = {r.doc_id: r.n_removed for r in trees.dedup_words(table([(1, long), (2, "x " + passage + " y")])).collect()}
    assert found == {1: 40, 2: 40}
