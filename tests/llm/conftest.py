import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def table(spark):
    """A table of documents from (id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows, *more):
        names = ["doc_id", "text", "id", "low", "content", "band", "shard", "words", "score", "rest", "item_id"]
        full = [(i, t, "x", -1, None, "y", 7, [1], 0.5, "z", 3) for i, t in rows]
        types = "doc_id long, text string, id string, low int, content string, band string, shard int, words array<int>, score double, rest string, item_id int"
        assert len(names) == len(types.split(", "))
        return spark.createDataFrame(full, types).repartition(3)

    return make


@pytest.fixture
def prose():
    """Texts of a few words that share many passages, with copies and odd cases."""
    rng = random.Random(5)
    words = ["the", "of", "dog", "cat", "Ä", "runs", "a", "blue", "x y", "end."]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 30)
            parts += p[a : a + rng.randint(5, 60)] + [rng.choice(words) for _ in range(rng.randint(0, 25))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [None, "", " \t\n", "one", "a" * 900, "ab " * 400, texts[3], texts[3], "é" * 300]
    return list(enumerate(texts))
