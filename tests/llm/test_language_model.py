import numpy as np
import pytest
from helpers import bigram_scores, fold
from pyspark.sql import functions as F

from postflow.llm import lm


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top, n in ((64, 500), (10, 300), (64, 0), (64, 1), (3, 40)):
        high = 2**top - 1
        values = np.sort(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
        packed = lm.EliasFano(*lm.EliasFano.pack(values, top))
        if n:
            assert (packed.get(np.arange(n)) == values).all()
        unique = lm.EliasFano(*lm.EliasFano.pack(np.unique(values), top))
        keys = np.concatenate([values, rng.integers(0, high, 50, dtype=np.uint64)])
        where = {v: k for k, v in enumerate(np.unique(values).tolist())}
        assert unique.find(keys).tolist() == [where.get(k, -1) for k in keys.tolist()]


def test_trie():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(rng.integers(0, 2**64, dtype=np.uint64)) // 7 * 7 % (2**60), int(rng.integers(0, 2**48))) for _ in range(300)})
    pairs = sorted({(c % 50 * 2**50 + 5, s) for c, s in pairs})
    contexts, first = np.unique(np.array([c for c, _ in pairs], np.uint64), return_index=True)
    codes = np.arange(1, len(pairs) + 1).astype(np.uint16)
    trie = lm.Trie(contexts, np.append(first, len(pairs)), np.array([s for _, s in pairs], np.uint64), codes)
    asked = [*pairs, (pairs[0][0], 3), (9, 9), (int(contexts[3]), pairs[0][1])]
    want = dict(zip(pairs, codes.tolist()))
    found = trie.look_up(np.array([c for c, _ in asked], np.uint64), np.arange(len(asked)), np.array([s for _, s in asked], np.uint64))
    assert found.tolist() == [want.get(p, 0) for p in asked]
    trie.close()


def test_codes():
    ratio = np.array([1.0, 0.5, 1e-3, 1e-9])
    assert np.abs(np.log10(lm.code_ratio(lm.ratio_code(ratio))) - np.log10(ratio)).max() <= 0.5 / lm.CODES + 1e-12
    assert lm.code_ratio(np.zeros(1, np.uint16))[0] == 0


@pytest.mark.parametrize("chunk, hot", [(9 << 20, 4000), (700, 4000), (700, 20)])
def test_scores(table, prose, monkeypatch, chunk, hot):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    docs = table(prose)
    train = F.crc32(docs.doc_id.cast("string").cast("binary")) % 3 != 2
    found = {r.doc_id: r for r in lm.score(docs, train, mu=3.0).collect()}
    want = bigram_scores(prose, lambda i: fold(i, 3) != 2, 3.0)
    assert set(found) == set(want)
    for i, (tokens, known, total, base, score) in want.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 3) == 2, tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert abs(r.score - score) <= tokens / lm.CODES


def test_odd_tables(table):
    assert lm.score(table([]), F.lit(True)).count() == 0
    found = lm.score(table([(1, "a b"), (None, None), (1, "a b")]), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in found) == [(1, 0, 0), (3, 0, 0), (3, 0, 0)]
    found = lm.score(table([(1, "a b"), (None, None), (1, "a b")]), F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in found) == [(1, 1, 7), (3, 3, 7), (3, 3, 7)]
