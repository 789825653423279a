"""T15, A5-A11, N1-N4, M5, M6 against the worked example and against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.operators import ngrams as ng
from postflow.operators import scoring as sc
from postflow.operators import skew

EXAMPLE = [["cat", "dog", "cat"], ["shark", "cat"], ["dog", "lamb"], []]


def posts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t array<string>")


def by_id(df, c):
    return {row["id"]: row[c] for row in df.collect()}


def close(found, wanted):
    assert found.keys() == wanted.keys()
    for key, value in wanted.items():
        assert found[key] == (None if value is None else pytest.approx(value, rel=1e-9)), key


def test_ngrams(spark):
    df = posts(spark, [["a", "b", "c"], ["a"], []])
    assert by_id(ng.with_ngrams(df, 2, "t", "g"), "g") == {0: [["a", "b"], ["b", "c"]], 1: [], 2: []}
    assert by_id(ng.with_ngrams(df, 1, "t", "g"), "g") == {0: [["a"], ["b"], ["c"]], 1: [["a"]], 2: []}
    assert by_id(df.select("id", ng.ngram_terms("t", 3).alias("g")), "g") == {
        0: [ng.GLUE.join("abc")], 1: [], 2: [],
    }


def test_frequency_and_its_denominators(spark):
    df = posts(spark, EXAMPLE)
    rows = {tuple(r.gram): (r.frequency, r.relative_frequency) for r in ng.gram_frequency(df, 1, "t").collect()}
    assert rows == {("cat",): (3, 0.75), ("dog",): (2, 0.5), ("shark",): (1, 0.25), ("lamb",): (1, 0.25)}
    total = ng.gram_frequency(df, 1, "t", denominator="total")
    assert total.agg(F.sum("relative_frequency")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        ng.gram_frequency(df, 1, "t", denominator="other")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_gram_counts_add_up(spark, n):
    rows = [["w"] * k for k in range(8)]
    found = ng.gram_frequency(posts(spark, rows), n, "t").agg(F.sum("frequency")).first()[0]
    assert found == sum(max(len(row) - n + 1, 0) for row in rows)


def test_edge_words(spark):
    rows = {(r.side, r.word): r.frequency for r in ng.edge_words(posts(spark, EXAMPLE), "t").collect()}
    assert rows == {
        ("first", "cat"): 1, ("first", "shark"): 1, ("first", "dog"): 1,
        ("last", "cat"): 2, ("last", "lamb"): 1,
    }


def test_worked_example(spark):
    df = posts(spark, EXAMPLE[:3])
    close(by_id(sc.unigram_score(df, ["id"], "t"), "unigram_probability"), {0: 0.28125, 1: 0.1875, 2: 0.125})
    assert by_id(sc.bigram_score(df, ["id"], "t"), "bigram_probability")[0] == pytest.approx(1 / 27)
    close(by_id(sc.relative_score(df, ["id"], "t"), "relative_probability"), {0: 16 / 37, 1: 12 / 37, 2: 9 / 37})


def test_empty_and_short_posts(spark):
    df = posts(spark, [["a", "b"], ["a"], []])
    assert by_id(sc.unigram_score(df, ["id"], "t"), "unigram_probability")[2] == 1.0
    bigrams = sc.bigram_score(df, ["id"], "t")
    assert by_id(bigrams, "bigram_logprob")[1] is None
    assert by_id(bigrams, "bigram_probability")[1] == by_id(bigrams, "bigram_probability")[2] == 0.0
    assert by_id(sc.relative_score(df, ["id"], "t"), "relative_probability")[2] == 0.0


def brute_force(rows, smoothing=False):
    """The three scores, straight from their definitions."""
    uni = collections.Counter(w for t in rows for w in t)
    bi = collections.Counter(p for t in rows for p in zip(t, t[1:]))
    tri = collections.Counter(p for t in rows for p in zip(t, t[1:], t[2:]))
    first = collections.Counter(t[0] for t in rows if t)
    last = collections.Counter(t[-1] for t in rows if t)
    n, v = len(rows), len(uni)
    a, b = (1, v) if smoothing else (0, 0)
    unigram, bigram, trigram = {}, {}, {}
    for i, t in enumerate(rows):
        unigram[i] = sum(math.log(uni[w] / v) for w in t)
        bigram[i] = trigram[i] = None
        if len(t) > 1:
            bigram[i] = sum(math.log((bi[p] + a) / (uni[p[0]] + b)) for p in zip(t, t[1:]))
            bigram[i] += math.log(first[t[0]] / n) + math.log(last[t[-1]] / n)
        if len(t) > 2:
            trigram[i] = sum(math.log((tri[p] + a) / (bi[p[:2]] + b)) for p in zip(t, t[1:], t[2:]))
    return unigram, bigram, trigram


@pytest.fixture(scope="module")
def skewed_rows():
    """Posts in which one word is a third of all words, and copies of one post abound."""
    rng = random.Random(7)
    rows = []
    for _ in range(120):
        size = rng.choice([0, 1, 2, 3, 10, 40])
        rows.append(["hot" if rng.random() < 0.33 else f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(size)])
    return rows + [["same", "post", "hot"]] * 60


# With few hot entries the scores take both the broadcast way and the shuffle way.
@pytest.mark.parametrize("hot_entries", [skew.HOT_ENTRIES, 20, 0])
def test_scores_equal_brute_force(spark, skewed_rows, monkeypatch, hot_entries):
    monkeypatch.setattr(skew, "HOT_ENTRIES", hot_entries)
    df = posts(spark, skewed_rows)
    unigram, bigram, trigram = brute_force(skewed_rows)
    close(by_id(sc.unigram_score(df, ["id"], "t"), "unigram_logprob"), unigram)
    close(by_id(sc.bigram_score(df, ["id"], "t"), "bigram_logprob"), bigram)
    close(by_id(sc.trigram_score(df, ["id"], "t"), "trigram_logprob"), trigram)
    both = sc.post_scores(df, ["id"], "t")
    close(by_id(both, "unigram_logprob"), unigram)
    close(by_id(both, "bigram_logprob"), bigram)


def test_smoothed_scores_equal_brute_force(spark, skewed_rows):
    df = posts(spark, skewed_rows)
    _, bigram, trigram = brute_force(skewed_rows, smoothing=True)
    close(by_id(sc.bigram_score(df, ["id"], "t", smoothing=True), "bigram_logprob"), bigram)
    close(by_id(sc.trigram_score(df, ["id"], "t", smoothing=True), "trigram_logprob"), trigram)


def test_long_hot_terms_are_broadcast(spark):
    """An 80-character term in every post is looked up without a shuffle of it; so are its twins."""
    long = "x" * 80
    rows = [[long, "x" * 81, "x" * 64, "y"]] * 20 + [[long]]
    df = posts(spark, rows)
    close(by_id(sc.unigram_score(df, ["id"], "t"), "unigram_logprob"), brute_force(rows)[0])
    table = spark.createDataFrame([(long, 500_000, 1.0), ("rare", 1, 2.0)], "term string, frequency long, value double")
    hot, cold = skew._split(table)
    assert [r.value for r in hot.collect()] == [1.0] and [r.term for r in cold.collect()] == ["rare"]
    terms = spark.createDataFrame([(1, long), (2, "rare"), (3, "x" * 79 + "z"), (4, None)], "id int, term string")
    assert sorted(tuple(r) for r in skew.lookup(terms, table).select("id", "value").collect()) == [(1, 1.0), (2, 2.0)]
    found = skew.sum_of_lookups(terms, table, ["id"]).collect()
    assert sorted((r.id, r.terms, r.total) for r in found if r.total is not None) == [(1, 1, 1.0), (2, 1, 2.0)]


def test_shares(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 3.0, 0.0)], "id int, a double, b double")
    shares = sc.share_of_total(df, ["a", "b"])
    assert [tuple(r) for r in shares.orderBy("id").collect()] == [(1, 0.25, None), (2, 0.75, None)]
    logs = spark.createDataFrame([(1, -5000.0), (2, -5000.0), (3, None)], "id int, l double")
    assert by_id(sc.share_of_log_total(logs, "l", "s"), "s") == {1: 0.5, 2: 0.5, 3: 0.0}


def test_unscored_posts_can_be_left_out(spark):
    df = sc.bigram_score(posts(spark, [["a", "b"], ["a"]]), ["id"], "t")
    assert [r.id for r in sc.drop_unscored(df, ["bigram_logprob"]).collect()] == [0]


def test_shares_need_no_single_partition_of_rows(spark):
    df = spark.range(10).selectExpr("id", "id * 1.0d as x")
    plan = sc.share_of_total(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# With few heavy words all ways to deal a gram are taken.
@pytest.mark.parametrize("heavy", [1, 8, 1000])
def test_chains_of_heavy_words(spark, skewed_rows, monkeypatch, heavy):
    monkeypatch.setattr(sc, "HEAVY", heavy)
    df = posts(spark, skewed_rows)
    unigram, bigram, trigram = brute_force(skewed_rows)
    close(by_id(sc.bigram_score(df, ["id"], "t"), "bigram_logprob"), bigram)
    close(by_id(sc.trigram_score(df, ["id"], "t"), "trigram_logprob"), trigram)
    both = sc.post_scores(df, ["id"], "t")
    close(by_id(both, "unigram_logprob"), unigram)
    close(by_id(both, "bigram_logprob"), bigram)


def test_grams_travel_once(spark):
    """Grams are not stored, and shuffled once: what is written is the counts of words."""
    df = posts(spark, EXAMPLE)
    for score in (sc.bigram_score, sc.trigram_score, sc.post_scores):
        found = score(df, ["id"], "t")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "lookups-" not in plan and plan.count("RepartitionByExpression") == 1


# Slices and buckets of a few grams: a gram, a head and a post are in many of them.
@pytest.mark.parametrize("heavy", [8, 1000])
def test_grams_travel_packed(spark, skewed_rows, monkeypatch, heavy):
    monkeypatch.setattr(sc, "HEAVY", heavy)
    monkeypatch.setattr(sc.chains, "SLICE_WORDS", 50)
    monkeypatch.setattr(sc.chains, "BUCKET_GRAMS", 100)
    rows = [*skewed_rows, ["é", "", "é"], None]
    df = posts(spark, rows)
    _, bigram, trigram = brute_force(rows[:-2])
    for score, n in ((sc.bigram_score, 2), (sc.trigram_score, 3)):
        found = score(df, ["id"], "t")
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == len(rows)
    df = posts(spark, skewed_rows)
    close(by_id(sc.bigram_score(df, ["id"], "t"), "bigram_logprob"), bigram)
    close(by_id(sc.trigram_score(df, ["id"], "t"), "trigram_logprob"), trigram)


def test_packed_numbers():
    for numbers in ([0], [3, 255], [256, 0, 70_000], [2**32 - 1, 5]):
        assert sc.chains._numbers(sc.chains._planes(np.array(numbers))).tolist() == numbers
    far = [np.array([5, 2**40, 5]), np.array([2**40, 1, 2**40])]
    assert (np.unique(sc.chains._numbered(far), return_inverse=True)[1] == [0, 1, 0]).all()


@pytest.mark.parametrize("n", [4, 5])
def test_long_grams_travel_in_runs(spark, skewed_rows, n):
    rows = [*skewed_rows, None]
    wanted = collections.Counter(ng.GLUE.join(t[i : i + n]) for t in skewed_rows for i in range(len(t) - n + 1))
    df = posts(spark, rows)
    assert {r.term: r.frequency for r in ng.count_grams(df, n, "t").collect()} == wanted
    runs = ng.gram_runs(df, n, "t").agg(F.sum(F.size(F.split("run", ng.GLUE)))).first()[0]
    assert runs < 0.75 * n * sum(wanted.values())
    assert ng.count_grams(posts(spark, [["a"], []]), n, "t").count() == 0
