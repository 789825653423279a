"""Counts, stems and sketches that grow by increments equal those of one pass."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.functions.stem import english_stem
from postflow.operators import counts as ct
from postflow.operators import ngrams as ng
from postflow.operators import vectors as ve
from postflow.operators.stems import StemDictionary, with_stems

WORDS = """consign consigned consigning consignment consist consistency knack knackeries knaves knavish knee kneeled knightly
    knots skis skies dying lying tying idly gently ugly early only singly news howe atlas cosmos bias andes inning outings
    canning herring earrings proceed exceeds succeeded generate communities arsenal happy cry by say boy enjoyed yyyy ayy
    youth's boys' o'neil 'tis caresses ties ies gas this kiwis cried feed agreed agreedly plastered bled motoring sing
    conflated troubled sized hopping tanned falling hissing fizzed failing filing relational conditional rational valenci
    digitizer operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti analogi theologi
    goodli li triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner
    adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti
    effective bowdlerize probate rate cease controll roll übel größe naïve x yy a 123 ed ing""".split()


def random_words(n):
    rng = random.Random(3)
    ends = ["", "s", "ed", "ing", "ly", "li", "ational", "iveness", "e", "ll", "y", "ies", "eedly", "'s", "ion", "ative", "bb", "ousli"]
    return ["".join(rng.choice("aeiouybcdlst'Y"[:13]) for _ in range(rng.randint(1, 6))) + rng.choice(ends) + rng.choice(ends) for _ in range(n)]


def test_expressions_stem_as_the_function_does(spark):
    words = sorted({*WORDS, *random_words(3000)})
    found = with_stems(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"))
    assert found.columns == ["word", "stem"]
    got = {r["word"]: r["stem"] for r in found.collect()}
    assert {w: s for w, s in got.items() if w is not None and s != english_stem(w)} == {} and got[None] is None


def test_the_dictionary_grows_by_new_words(spark, tmp_path):
    words = StemDictionary(spark, str(tmp_path / "stems"))
    posts = spark.createDataFrame([(1, ["cats", "liked", "cats"]), (2, []), (3, None), (4, ["dogs", "cats", None])], "id int, t array<string>")
    assert words.add(posts.filter("id < 3"), "t") == 2
    assert words.add(posts, "t") == 1 and words.add(posts, "t") == 0
    assert sorted(map(tuple, words.read().collect())) == [("cats", "cat"), ("dogs", "dog"), ("liked", "like")]
    found = {r["id"]: r["stem_tokens"] for r in words.stemmed(posts.filter("id < 4"), "id", "t").collect()}
    assert found == {1: ["cat", "like", "cat"], 2: [], 3: []}


@pytest.mark.parametrize("n", [1, 2])
def test_three_increments_equal_a_full_count(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]) for k in range(90)]
    spark.createDataFrame(rows, "id int, t array<string>").write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    counts = ct.GramCounts(spark, str(tmp_path / "counts"), n, buckets=4)
    for k in range(3):
        counts.add(posts.filter(f"id % 3 = {k}"), "t", ("load", k))
        counts.add(posts.filter(f"id % 3 = {k}"), "t", ("load", k))
        before = counts.table.manifest().parts
        if k == 1:
            counts.compact(1)
            assert all(len(f) == 1 for f in counts.table.manifest().parts.values()) and any(len(f) == 2 for f in before.values())
    same = lambda df: sorted((r["gram"], r["frequency"], r["relative_frequency"]) for r in df.collect())
    for denominator in ("distinct", "total"):
        assert same(counts.frequency(denominator)) == same(ng.gram_frequency(posts, n, "t", denominator))
    files = counts.frequency().inputFiles()
    assert files and all("/counts/data/" in f for f in files)  # no old posts are read


def test_fuzzy_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) + 8])
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(200, None), (201, [1.0]), (202, [float("nan")] * 3), (203, x[0].tolist())]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    found = {r["id"]: r for r in ve.fuzzy_clusters(df.filter("id != 201"), "v", 2, centers="centers", tolerance=1e-9).collect()}
    centers = np.array(found[0]["centers"])
    want = ve.degrees(x, centers, 2.0)
    assert np.allclose([found[k]["membership"] for k in range(100)], want) and np.allclose(want.sum(axis=1), 1)
    w = np.vstack([want, want[:1]]) ** 2
    assert np.allclose(w.T @ np.vstack([x, x[:1]]) / w.sum(axis=0)[:, None], centers, atol=1e-6)
    assert found[200]["membership"] is None and found[202]["membership"] is None
    assert {int(np.argmax(found[k]["membership"])) for k in range(60)} != {int(np.argmax(found[k]["membership"])) for k in range(60, 100)}
    few = ve.fuzzy_clusters(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, v array<double>"), "v", 2)
    assert sorted(max(r["membership"]) for r in few.collect()) == [1.0, 1.0]  # points on centres belong to those alone
    assert ve.fuzzy_clusters(df.limit(0), "v", 2).count() == 0


def test_sketches_of_any_days(spark):
    posts = spark.range(60_000).select(
        F.lit("g").alias("group"), F.expr("date_add(DATE '2024-01-01', cast(id % 10 as int))").alias("date"), (F.col("id") % 20_011).cast("string").alias("user")
    )
    sketches = ct.user_sketches(posts)
    assert sketches.count() == 10
    for first, last, users in (("2024-01-01", "2024-01-10", 20_011), ("2024-01-03", "2024-01-03", 6_000)):
        about = ct.users_between(sketches, first, last).first()["users"]
        assert math.isclose(about, users, rel_tol=4 * ct.SKETCH_ERROR)
    assert ct.users_between(sketches, "2025-01-01", "2025-01-02").count() == 0


def test_an_increment_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Grams are counted where their bucket is written, also when buckets are compacted; nothing is rebalanced."""
    plans = []
    stored = ct.SnapshotTable._stored

    def seen(self, rows, part, dealt=False):
        plans.append((rows._jdf.queryExecution().executedPlan().toString().count("Exchange"), dealt))
        return stored(self, rows, part, dealt)

    monkeypatch.setattr(ct.SnapshotTable, "_stored", seen)
    posts = spark.createDataFrame([(["a", "b", "a", "b"],), (["b", "a"],), ([],)], "t array<string>")
    counts = ct.GramCounts(spark, str(tmp_path / "counts"), 2, buckets=3)
    for number in range(2):
        counts.add(posts, "t", ("load", number))
    counts.compact(1)
    assert plans == [(1, True)] * 3
    assert {r.term: r.frequency for r in counts.counts().collect()} == {"a\x1fb": 4, "b\x1fa": 4}
