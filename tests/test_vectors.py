"""M1-M4, M7."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.operators import skew
from postflow.operators import vectors as ve


@pytest.mark.parametrize("hot_entries", [skew.HOT_ENTRIES, 2])
def test_tf_idf(spark, monkeypatch, hot_entries):
    monkeypatch.setattr(skew, "HOT_ENTRIES", hot_entries)
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "id int, t array<string>")
    found = {(r.id, r.term): (r.frequency, r.tf_idf) for r in ve.tf_idf(df, ["id"], "t").collect()}
    a, b = math.log(4 / 3), math.log(4 / 2)
    assert found == {
        (1, "a"): (2, pytest.approx(2 * a)), (1, "b"): (1, pytest.approx(b)), (2, "a"): (1, pytest.approx(a)),
    }


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(20 * (i % 2), 1), rng.gauss(0, 1), 0.5 * i % 2]) for i in range(200)]
    return spark.createDataFrame(rows, "id int, v array<double>")


def test_clusters_find_the_two_heaps(points):
    hard = {r.id: r.cluster for r in ve.hard_clusters(points, "v", 2).collect()}
    assert len(hard) == 200 and {(i % 2, c) for i, c in hard.items()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    soft = ve.soft_clusters(points, "v", 2).collect()
    assert all(sum(r.membership) == pytest.approx(1) and len(r.membership) == 2 for r in soft)


def test_first_component_parts_the_heaps(points):
    found = ve.principal_components(points, "v", 1).select("id", F.col("components")[0].alias("c")).collect()
    even, odd = [[r.c for r in found if r.id % 2 == k] for k in (0, 1)]
    assert max(even) < min(odd) or max(odd) < min(even)


def test_word_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],)], "t array<string>")
    found = ve.word_vectors(df, "t", size=4, min_count=2, partitions=2)
    assert {r.word: len(r.vector) for r in found.collect()} == {"a": 4, "b": 4}


def test_cooccurrences(spark):
    df = spark.createDataFrame([(["a", "b", "a", None, "c"],), (["c"],), ([],), (None,)], "t array<string>")
    found = {(r.word, r.other): r.n for r in ve.cooccurrences(df, "t", 2).collect()}
    assert found == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("a", "c"): 1, ("c", "a"): 1}


def test_cooccurrence_vectors_span_the_strongest_directions(spark):
    rng = random.Random(3)
    topics = [["red", "blue", "green", "pink"], ["cat", "dog", "cow", "hen", "pig"], ["one", "two", "six"]]
    rows = [[rng.choice(topics[k % 3] if rng.random() < 0.9 else sum(topics, [])) for _ in range(30)] for k in range(60)] + [["alone"]]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>").repartition(3)
    n = collections.Counter((r[i], r[j]) for r in rows for i in range(len(r)) for j in range(len(r)) if 0 < abs(i - j) <= 2)
    words = sorted({w for r in rows for w in r})
    counts = np.array([[n[a, b] for b in words] for a in words], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.nan_to_num(np.maximum(np.log(counts * counts.sum() / np.outer(counts.sum(1), counts.sum(1))), 0), neginf=0)
    left, strength, _ = np.linalg.svd(plain)
    found = {r.word: r.vector for r in ve.cooccurrence_vectors(df, "t", size=3, rounds=20).collect()}
    ours = np.array([found[w] for w in words])
    assert sorted(found) == words and not any(found["alone"])
    assert ours @ ours.T == pytest.approx(left[:, :3] * strength[:3] @ left[:, :3].T, abs=1e-3)


@pytest.mark.parametrize("hot", [4, 100_000])
def test_cooccurrence_vectors_send_hot_and_cold_words_by_different_ways(spark, monkeypatch, hot):
    """whichever words count as hot, a round multiplies by all weights; a hot pair travels as one number."""
    rng = random.Random(5)
    tables = {}
    monkeypatch.setattr(ve, "HOT_ENTRIES", hot)
    monkeypatch.setattr(ve, "materialise", lambda df, name, write=ve.materialise: tables.setdefault(name, write(df, name)) if name.endswith("pairs") else write(df, name))
    rows = [[rng.choice(["the", "of", *"abcdefghij", "", None]) if rng.random() < 0.8 else rng.choice(["the", "of"]) for _ in range(rng.randrange(40))] for _ in range(30)]
    rows += [["rare", "rare", "rare"], ["rare", "seldom", None, "rare"], ["alone"], [], [None]]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "t array<string>").repartition(3)
    n = collections.Counter((r[i], r[j]) for r in rows for i in range(len(r)) for j in range(len(r)) if 0 < abs(i - j) <= 2 and r[i] is not None and r[j] is not None)
    words = sorted({w for r in rows for w in r if w is not None})
    counts = np.array([[n[a, b] for b in words] for a in words], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.nan_to_num(np.maximum(np.log(counts * counts.sum() / np.outer(counts.sum(1), counts.sum(1))), 0), neginf=0)
    start = np.array([[int(hashlib.md5(f"{w}:{k}:0".encode()).hexdigest()[:8], 16) / (1 << 32) - 0.5 for k in range(2)] for w in words])
    space, _ = np.linalg.qr(plain @ plain @ start)
    found = {r.word: r.vector for r in ve.cooccurrence_vectors(df, "t", size=2, rounds=2, power=0.0).collect()}
    ours = np.array([found[w] for w in words])
    assert sorted(found) == words and not any(found["alone"])
    assert ours @ ours.T == pytest.approx(space @ space.T, abs=1e-8)
    assert tables["hot-pairs"].dtypes == [("pair", "bigint"), ("n", "bigint")] and tables["hot-pairs"].count() > 0
    assert (tables["cold-pairs"].count() > 0) == (hot == 4)


def test_cooccurrence_vectors_of_few_or_no_words(spark):
    few = spark.createDataFrame([(["a", "b"],), (["c", "d"],)], "t array<string>")
    found = {r.word: r.vector for r in ve.cooccurrence_vectors(few, "t", size=8, rounds=2).collect()}
    assert sorted(found) == ["a", "b", "c", "d"] and {len(v) for v in found.values()} == {4}
    assert np.isfinite([v for v in found.values()]).all()
    none = spark.createDataFrame([([],), (None,)], "t array<string>")
    assert ve.cooccurrence_vectors(none, "t", size=2, rounds=2).count() == 0


@pytest.mark.parametrize("iterations", [1, 3])
def test_word_vectors_stay_off_the_driver(spark, monkeypatch, iterations):
    """All words come back from any number of slices, and words with the same neighbours end closer than others."""
    monkeypatch.setattr(ve, "SLICE_WORDS", 4000)
    rng = random.Random(1)
    topics = [["red", "blue", "green", "pink"], ["cat", "dog", "cow", "hen"]]
    rows = [(rng.choices(topics[k % 2], k=30),) for k in range(600)] + [(["alone"],), ([],), (None,), ([None, "alone"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    with monkeypatch.context() as m:
        m.setattr(ve, "RATE", 0.05)
        found = {r.word: np.array(r.vector) for r in ve.word_vectors(df, "t", size=8, iterations=iterations, partitions=2).collect()}
    assert sorted(found) == sorted([*topics[0], *topics[1], "alone"]) and all(len(v) == 8 for v in found.values())

    def cosine(a, b):
        return found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])

    assert min(cosine("red", w) for w in topics[0]) > max(cosine("red", w) for w in topics[1])
    assert ve.word_vectors(df.limit(0), "t", size=2, iterations=iterations).count() == 0
