"""Chat formatting, the prefix trie and centroid clusters against plain versions."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.llm import chat, nsbounds, trie
from postflow.llm import queries as q

SAID = "</s>[INST] ok [/INST]"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _write(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{table}.parquet")


CONVERSATIONS = "conv_id long, turn long, role string, text string, leaf int, place string, tree long"


def _conversations(seed=3):
    """Conversations that share turns and whole beginnings, with odd rows."""
    rng = random.Random(seed)
    texts = ["hi", "", None, SAID, "a\\b\\\\", "<|eot_id|>", "\\<|eot_id|>x\n\n", "é🙂", "<s>" * 3, "long " * 3000]
    rows = []
    for c in [*range(0, 30), *range(98, 130), 200, 205, 399, 400]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "", "<|eot_id|>"]), rng.choice(texts)))
    for c in range(1000, 1040):  # whole copies, and copies that go on
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(3 + c % 2 * 2)]
    rows += [(300, None, "user", "first"), (300, 5, "user", "same"), (300, 5, "user", "same"), (None, 0, "user", "nowhere")]
    rows += [(500, t, "user", str(t // 2)) for t in range(120)]
    rows += [(c, 0, "user", "gone with the first turns of an absent one") for c in range(701, 711)]
    return [(*r, 1, "x", 7) for r in rows]


def _ordered(rows):
    """conv_id -> [(role, text)] by turn, null first."""
    found = defaultdict(list)
    for c, t, role, text, *_ in rows:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in found.items()}


def test_chat_digest(spark, tmp_path):
    rows = _conversations()
    _write(spark, tmp_path, "conversations", rows, CONVERSATIONS)
    found = {r["conv_id"]: r for r in q.op11_chat(spark, str(tmp_path)).collect()}
    plain = _ordered([*rows, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)])
    assert set(found) == set(plain)
    for c, turns in plain.items():
        r, learned = found[c], "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learned)), c
        assert r["turns_sha256"] == _sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_sha256"] == _sha(learned)


def test_chat_paths_ranks_and_marks(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 9.0), ("t", 3, 1, "assistant", "bad", 1.0),
        ("t", 4, 3, "user", "why?", 1.0), ("t", 5, 99, "user", "its parent is absent", None),
        ("o", 7, 8, "user", "a circle", 1.0), ("o", 8, 7, "user", "a circle", 1.0), ("o", 9, 8, "user", "hangs on it", 1.0),
        (None, 1, None, "assistant", None, 2.0),
    ]
    table = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    found = {(r["tree"], r["leaf"]): r for r in chat.format_trees(table, "tree", "node", "parent", score="score").collect()}
    assert {k: (r["rank"], r["n_turns"]) for k, r in found.items()} == {("t", 2): (1, 2), ("t", 4): (2, 3), ("t", 5): (3, 1), (None, 1): (1, 1)}
    assert found["t", 2]["formatted"] == (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\ngood<|eot_id|>"
    )
    for r in found.values():
        data = r["formatted"].encode()
        learned = [data[s["start"] : s["start"] + s["size"]].decode() for s in r["loss"]]
        assert learned == {("t", 2): ["good"], ("t", 4): ["bad"], ("t", 5): [], (None, 1): [""]}[r["tree"], r["leaf"]]
    best = chat.format_trees(table, "tree", "node", "parent", score="score", branches=1)
    assert sorted(((r["tree"], r["leaf"]) for r in best.collect()), key=str) == sorted([("t", 2), (None, 1)], key=str)


def test_chat_long_chain_and_wide_tree(spark):
    chain = spark.range(300).select(F.lit(1).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    found = chat.format_trees(chain, "tree", "node", "parent").select("n_turns", chat.read_turns(F.col("formatted")).alias("turns")).first()
    assert found["n_turns"] == 300 and [t["text"] for t in found["turns"]] == [str(k) for k in range(300)]
    star = chain.withColumn("parent", F.when(F.col("node") > 0, 0))
    assert chat.format_trees(star, "tree", "node", "parent").agg(F.count("rank"), F.max("rank"), F.sum("n_turns")).first()[:] == (299, 299, 598)


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<|eot_id|>", "<\\|eot_id|>", "\\<|eot_id|>\\", "[[INST]]", "</s></s>", "<<s>s>"])
def test_chat_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row["u"] == text and not any(mark in row["e"] for mark in chat.Template().control)


def test_chat_native(spark, tmp_path):
    _write(spark, tmp_path, "conversations", _conversations()[:40], CONVERSATIONS)
    plan = q.op11_chat(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Arrow", "Python", "Pandas"))


def _trie(rebuilt):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    return {
        (min(m), len(p)): (
            min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
            _sha(",".join(str(c) for c in sorted(m) if rebuilt[c] == p)),
        )
        for p, m in members.items()
    }


def _nodes(df):
    rows = df.collect()
    found = {(r[0], r[1]): r[2:] for r in rows}
    assert len(found) == len(rows)
    return {k: tuple(v) for k, v in found.items()}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_trie_query(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    rows = _conversations()
    _write(spark, tmp_path, "conversations", rows, CONVERSATIONS)
    code = lambda t: (hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest(), len(t[1]))
    turns = defaultdict(list)
    for c, n, role, text, *_ in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, code((role or "", text or "")), (role or "", text or "")))
    turns = {c: tuple(x[3] for x in sorted(v)) for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, ())[:h] + own[h:]
    assert () in rebuilt.values()
    assert _nodes(q.op12_prefix_trie(spark, str(tmp_path))) == _trie(rebuilt)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_sequences(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "BLOCK_ROWS", rng.choice([1, 2, 5]))
    convs = {c: tuple(("u", rng.choice(["a", "bb"])) for _ in range(rng.choice([0, 1, 3, 8]))) for c in range(-5, 60)}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, place int, role string, text string").repartition(3)
    turns = turns.select("conv_id", "place", trie.turn_code(F.col("role"), F.col("text")).alias("code"))
    members = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert _nodes(trie.prefix_trie(turns, members)) == _trie(convs)


def test_trie_of_nothing(spark, tmp_path):
    _write(spark, tmp_path, "conversations", [], CONVERSATIONS)
    assert q.op12_prefix_trie(spark, str(tmp_path)).count() == 0
    assert [r["conv_id"] for r in q.op11_chat(spark, str(tmp_path)).collect()] == [-1]


def _kmeans(vectors, k, rounds):
    x = {}
    usable = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in usable], object)
    ids = [i for i, _ in usable]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), vectors_key(v), n) for n, (i, v) in enumerate(usable) if i is not None)
    centers = [list(x[n]) for _, _, n in order[:k]]

    def assign():
        out = []
        for v in x:
            away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        own = [c for c, _ in assign()]
        for c in range(len(centers)):
            members = [x[n] for n, o in enumerate(own) if o == c]
            if members:
                centers[c] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    inertia = defaultdict(int)
    for c, d in own:
        inertia[c] += d
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), _sha(",".join(map(str, centers[c])))) for i, (c, d) in zip(ids, own)), key=str
    )


def vectors_key(v):
    return json.dumps(v)


def _vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(size=64) * (0.2 if seed else 1e-3) + (i % 7)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [float("nan")] * 64), (n + 4, [None] * 64), (n + 5, [float("inf")] + [0.0] * 63)]
    rows += [(n + 6, [0.0] * 64), (n + 7, [0.0] * 64), (None, [-1.5] * 64), (rows[0][0], rows[0][1])]
    return rows


@pytest.mark.parametrize("n, seed", [(0, 1), (5, 1), (120, 0), (300, 2)])
def test_clusters_equal_plain_rounds(spark, tmp_path, n, seed):
    rows = _vectors(n, seed)
    _write(spark, tmp_path, "embeddings", [(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance double")
    found = q.op13_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == _kmeans(rows, 40, 5)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, [1.0] * 3)], [(None, [1.0] * 64)]):
        assert nsbounds.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_bounds_skip_distances_and_stay_exact():
    """After a few rounds most distances are not computed again, and what is found is the same."""
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (8, 64))[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 64))
    history = x[:8][None].copy()
    own, away, seen, turn = nsbounds.nearest(x, history[0])
    for t in range(1, 7):
        new = np.array([x[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else history[-1][c] for c in range(8)])
        history = np.concatenate([history, new[None]])
        own, away, seen, turn = nsbounds.tightened(x, history, own, seen.astype(np.float32).astype(float), turn)
        full = nsbounds.squared(x, new)
        assert (own == full.argmin(axis=1)).all() and (away == full.min(axis=1)).all()
    assert (turn == 6).mean() < 0.4


def test_distances_are_exact_for_large_components():
    x = np.array([[nsbounds.LIMIT] * 64, [-nsbounds.LIMIT] * 64, [3] * 64])
    assert nsbounds.squared(x, x[:2]).tolist() == [[0, 64 << 56], [64 << 56, 0], [64 * ((1 << 27) - 3) ** 2, 64 * ((1 << 27) + 3) ** 2]]
