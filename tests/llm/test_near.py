import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import contamination, lower

from postflow.llm import covertree, decontaminate, minhash
from postflow.llm.components import components

FLAT = np.ones(1 << minhash.FEATURE_BITS, np.float32)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings


def vectors(n=700, size=12):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, size))
    return centers[rng.integers(0, 20, n)] + rng.normal(size=(n, size)) * rng.choice([0.02, 0.2, 0.5], (n, 1))


@pytest.mark.parametrize("cosine", [0.9, 0.5, 0.999])
def test_tree_pairs(cosine, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 20)
    x = vectors()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:400], x[300:]
    found = sorted((i, j) for p, q in covertree.close_pairs(a, b, cosine) for i, j in zip(p.tolist(), q.tolist()))
    assert found == sorted(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= cosine))))


def test_tree_covers(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 20)
    x = vectors()
    open_ = [covertree.build(x)]
    while open_:
        node = open_.pop()
        assert np.linalg.norm(x[node.rows] - x[node.center], axis=1).max() <= node.radius + 1e-9
        if node.parts:
            assert sorted(np.concatenate([p.rows for p in node.parts])) == sorted(node.rows)
            assert node.parts[0].center == node.center and all(p.radius <= node.radius / 2 for p in node.parts)
            assert len(node.parts) <= covertree.MOST_PARTS
            open_ += node.parts


def expected(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = [(i, j) for k, (i, a) in enumerate(good) for j, b in good[k + 1 :] if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (links[i], label[i], label[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block", [4096, 40])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    x = vectors(200).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(300, x[3]), (301, x[3]), (302, [2 * c for c in x[5]])]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [None] + [1.0] * 11), (405, [1.0, 2.0]), (406, [1.0, 2.1]), (407, [float("inf")] * 12)]
    table = spark.createDataFrame([(i, v, 5, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int, rep int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(table).collect()}
    assert found == expected(rows)


def test_vectors_of_one_id_are_apart(spark):
    a, b, c, d = ([float(k == n) for k in range(4)] for n in range(4))
    near = lambda v: [x + 0.1 for x in v]
    rows = [(5, a), (6, near(a)), (7, b), (8, near(b)), (None, near(a)[::-1]), (None, c), (9, near(c)), (9, a), (4, b), (4, d)]
    found = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(5, 2, 5, True), (6, 2, 5, False), (7, 2, 4, False), (8, 2, 4, False), (9, 1, 9, True), (9, 2, 5, False)]
    want += [(4, 2, 4, True), (4, 1, 4, True), (None, 1, 4, False), (None, 1, 9, False)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_the_largest_id_is_an_id(spark):
    rows = [((1 << 63) - 1, [1.0, 0.0]), ((1 << 63) - 1, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01])]
    found = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    most = (1 << 63) - 1
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(most, 0, most, True), (most, 0, most, True), (None, 1, None, True), (None, 1, None, True)]))


def test_vectors_without_any(spark):
    table = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in covertree.near_vectors(table).collect()) == [(0, 0, True), (1, 0, True)]
    assert covertree.near_vectors(table.limit(0)).count() == 0


# --- documents


def near_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(25):
        w = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            own = list(w)
            for k in rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 60))):
                own[k] = word()
            rows.append(" ".join(own))
    rows += [rows[0], rows[0].upper(), rows[0].replace(" ", "\n"), None, "", " ", "one two", "one two", "ONE  two", "x " * 400]
    rng.shuffle(rows)
    return list(enumerate(rows))


def chained_rows():
    """Edit chains, hubs with spokes, and texts that resemble one spoke only, under shuffled ids."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def edited(words, at):
        return [*words[:at], word(), *words[at + 1 :]]

    texts = []
    for _ in range(10):
        hub = [word() for _ in range(60)]
        spokes = [edited(hub, k) for k in range(4, 60, 3)]
        ends = [edited(s, (4 + 3 * k + 27) % 56) for k, s in enumerate(spokes[::4])]
        texts += [hub, *spokes, *ends]
    for _ in range(10):
        own = [word() for _ in range(60)]
        for k in range(8):
            texts.append(own)
            own = edited(own, 5 + 6 * k)
    rng.shuffle(texts)
    return list(enumerate(map(" ".join, texts)))


def common_rows():
    """Copies with few edits of texts of words that are common in all of them."""
    rng = random.Random(12)
    pick = lambda: f"w{int(900 * rng.random() ** 4)}"
    texts = []
    for _ in range(40):
        base = [pick() for _ in range(60)]
        for _ in range(5):
            own = list(base)
            for k in rng.sample(range(60), rng.randint(0, 2)):
                own[k] = pick()
            texts.append(" ".join(own))
    return list(enumerate(texts))


def weighted_links(rows, least=0.8):
    """All pairs of rows of a weighted Jaccard similarity of ``least`` or more, by plain counting."""
    sets = []
    for _, t in rows:
        w = lower(t).split(" ") if " " in (t or "") else lower(t).split()
        w = [x for part in w for x in part.split()]
        sets.append(Counter(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    every = sorted({g for s in sets for g in s})
    feature = dict(zip(every, minhash.feature(np.concatenate([minhash.occurrences(pa.array([g], pa.large_string()))[1] for g in every])).tolist()))
    df = Counter(f for s in sets for f in {feature[g] for g in s})
    value = {g: 1 + math.log((1 + len(rows)) / (1 + df[feature[g]])) for g in every}
    total = [sum(n * value[g] for g, n in s.items()) for s in sets]
    found = []
    for k, x in enumerate(sets):
        for m in range(k + 1, len(sets)):
            if x and sets[m]:
                common = sum(min(n, sets[m][g]) * value[g] for g, n in x.items() if g in sets[m])
                s = common / (total[k] + total[m] - common)
                if s >= least:
                    found.append((k, m, s))
    return found


def weighted_classes(rows, links):
    """The smallest id of each row's class; a row without an id is not compared."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in links:
        if rows[a][0] is not None and rows[b][0] is not None:
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [None if i is None else least[root(k)] for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("make, block, shingles", [("near_rows", 2048, 1 << 20), ("chained_rows", 2048, 1 << 20), ("chained_rows", 5, 1 << 20), ("common_rows", 2048, 300)])
def test_classes_equal_brute_force(table, monkeypatch, make, block, shingles):
    """Recall is 1 here: every link of 0.8 or more is found, those below 0.9 too."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    rows = globals()[make]()
    links = weighted_links(rows)
    assert sum(s < 0.9 for *_, s in links) > 30 and len(links) > 80
    want = weighted_classes(rows, links)
    found = {r.doc_id: r for r in minhash.near_duplicates(table(rows)).collect()}
    assert len(found) == len(rows)
    assert {i: found[i].class_id for i, _ in rows} == {i: want[k] for k, (i, _) in enumerate(rows)}
    words = Counter(" ".join(lower(t).split()) for _, t in rows)
    for i, t in rows:
        assert found[i].kept == (found[i].class_id == i)
        assert found[i].n_copies == (words[" ".join(lower(t).split())] if (t or "").split() else 1)


def test_rows_of_one_id_are_apart(table):
    """A link of a text is not lost because its id has another text too, and one row of each class is kept."""
    rng = random.Random(1)
    a, b = (" ".join(f"{x}{rng.random()}" for _ in range(60)) for x in "ab")
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, b), (2, near), (2, b + " more"), (3, "alone"), (3, "apart")]
    for turned in (rows, rows[::-1]):
        found = minhash.near_duplicates(table(turned))
        assert sorted((r.doc_id, r.class_id, r.n_copies, r.kept) for r in found.collect()) == [
            (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 3, 1, True), (3, 3, 1, True),
        ]


def test_a_very_long_text(table):
    long = " ".join(f"w{k % 70_001}" for k in range(1_500_000))
    found = minhash.near_duplicates(table([(1, long), (2, long + " x"), (3, long[: len(long) // 2])])).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == [(1, 1), (2, 1), (3, 3)]


def test_near_duplicates_of_odd_tables(table):
    text = " ".join(f"w{k}" for k in range(40))
    found = minhash.near_duplicates(table([(1, text), (1, text), (2, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in found) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(table([])).count() == 0
    assert [r.kept for r in minhash.near_duplicates(table([(1, None)])).collect()] == [True]


def test_samples_collide_as_often_as_sets_are_similar():
    rng = np.random.default_rng(6)
    errors = []
    for n in (8, 40, 300):
        for _ in range(30):
            key = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = rng.uniform(0.1, 5, n) * (rng.random(n) < 0.9), rng.uniform(0.1, 5, n) * (rng.random(n) < 0.9)
            b = np.where(rng.random(n) < 0.7, a, b)
            if not a.any() or not b.any():
                continue
            draw = [minhash.samples(minhash.Shingles(np.zeros((w > 0).sum(), np.int64), key[w > 0], np.ones((w > 0).sum()), w[w > 0]), 1) for w in (a, b)]
            errors.append((draw[0] == draw[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.1


def test_weighted_similarity():
    texts = pa.array(["a b c d e f a b c d e", "A b c d e x", "", "a b"], pa.large_string())
    row, key = minhash.unrolled(minhash.shingles(texts, FLAT))
    keys = [key[row == k] for k in range(4)]
    # the first: (a b c d e) twice and 5 more shingles once; the second: (a b c d e) and (b c d e x) once
    every = np.arange(4)
    found = minhash.similarities(keys, every, every, FLAT)
    assert (found[0, 1], found[1, 0]) == pytest.approx((0.125, 0.125))
    assert not found[:2, 2:].any() and not found[2:, :2].any() and found[2, 3] == 0
    assert (minhash.feature(key) == minhash.feature(np.repeat(minhash.shingles(texts, FLAT).key, minhash.shingles(texts, FLAT).count))).all()


def test_idf(table):
    idf = minhash.shingle_idf(table([(1, "a b"), (2, "A  B"), (3, None), (4, "c c c c c c")]).selectExpr("doc_id as id", "text"))
    value = lambda t: float(idf[minhash.feature(minhash.occurrences(pa.array([t], pa.large_string()))[1])[0]])
    assert [value(t) for t in ("a b", "c c c c c", "unseen")] == pytest.approx([1 + np.log(5 / 3), 1 + np.log(5 / 2), 1 + np.log(5)])


# --- benchmark passages


def contaminated_rows(prose):
    rng = random.Random(9)
    words = [w for _, t in prose for w in (t or "").split()][:3000]
    items = [(k, " ".join(words[a : a + rng.randint(1, 30)])) for k, a in enumerate(rng.sample(range(2900), 25))]
    return [*items, (100, None), (101, ""), (102, "!!"), (103, "Unseen Words Only"), (104, "the"), (10, "dog, CAT")]


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination(spark, table, prose, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = contaminated_rows(prose)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = decontaminate.contaminated_docs(table(prose), bench).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == contamination(prose, items)


def test_contamination_of_odd_tables(spark, table):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contaminated_docs(table([(1, "a b"), (None, "a"), (1, "a b")]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in found) == [(0, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert decontaminate.contaminated_docs(table([]), bench).count() == 0


def test_proximity(table, prose):
    index = decontaminate.build_index(table(prose))
    queries = {"q": ["Dog", "blue"], "r": ["ä", "cat", "runs"], "none": ["unseen", "dog"]}
    found = {(r.doc_id, r.query, r.position) for r in decontaminate.proximity_matches(index, queries, 6).collect()}
    want = set()
    for i, t in prose:
        from helpers import lower
        import re

        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for name, own in queries.items():
            own = {lower(x) if x != "ä" else "ä" for x in own}
            want |= {(i, name, k) for k, x in enumerate(w) if x in own and own <= set(w[k : k + 6])}
    assert found == want
