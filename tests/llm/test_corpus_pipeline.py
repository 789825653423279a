"""The registered queries over whole tables against plain versions, and the pipeline's stages."""

import corpus_pipeline as cp
import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
from helpers import bigram_scores, contamination, dedup_bytes, dedup_words, fold, jaccard, sha

import __spark_entry__ as entry
from postflow.llm import bpe
from postflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_op1(spark, docs):
    want = {i: (n, gone, sha(kept.encode())) for i, (n, gone, kept) in dedup_words(docs, 35).items()}
    assert {i: tuple(r)[1:] for i, r in rows(spark, "op1_substring_dedup").items()} == want


def test_op3(spark, docs):
    found, want = rows(spark, "op3_lm_score"), bigram_scores(docs, lambda i: fold(i, 7) != 2, 100.0)
    assert set(found) == set(want)
    for i, (tokens, known, total, base, score) in want.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 7) == 2, tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-3)
    held_out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_op5(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = contamination(docs, items)
    assert {i: tuple(r)[1:] for i, r in rows(spark, "op5_contamination").items()} == want
    assert any(w[-1] for w in want.values())


def test_op7(spark, docs):
    want = {i: (n, gone, spans, sha(kept)) for i, (n, gone, spans, kept) in dedup_bytes(docs, 100).items()}
    assert {i: tuple(r)[1:] for i, r in rows(spark, "op7_suffix_dedup").items()} == want


def test_op8_urls(spark):
    found = QUERIES["op8_urls"](spark, SF).collect()
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    assert sorted(r.page_id for r in found) == sorted(urls)
    for r in found:
        rest = urls[r.page_id].partition("://")[2]
        assert rest.lower().startswith(r.host) and rest[len(r.host) :].startswith(r.path)


def test_stages_keep_columns_and_clean_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    found, before = given, None
    for name, stage in cp.STAGES[:-1]:
        before, found = found, stage(spark, found, SF)
        assert found.columns == given.columns and found.dtypes == given.dtypes, name
        found = spark.createDataFrame(found.collect(), given.schema)
    texts = {r.doc_id: r.text for r in given.collect()}
    kept = {r.doc_id: r for r in found.collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {i for i, r in contamination([(r.doc_id, r.text) for r in before.collect()], items).items() if r[-1]}
    assert bad and not bad & set(kept)
    for i in set(texts) - set(kept) - bad:  # what else went has a near copy that stayed, or went as contaminated
        own = texts[i]
        assert not any(c.isalpha() for c in own) or any(jaccard(own, t) >= 0.75 for j, t in texts.items() if j < i and t.split())
    for i, r in kept.items():
        assert r.n_chars == len(r.text) if r.text != texts[i] else True
    final = cp.STAGES[-1][1](spark, found, SF)
    coder = bpe.Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in final.collect():
        assert r.ids_sha256 == sha(" ".join(map(str, coder.encode(kept[r.doc_id].text))).encode())
        assert r.decoded_sha256 == sha(kept[r.doc_id].text.encode())


def test_odd_rows_pass_through(spark):
    long = " ".join(f"wort{k}" for k in range(60))
    data = [(1, "the garden of the house", "en"), (2, None, "en"), (None, "the old garden", None), (None, long, "en"), (3, long, "en"),
            (3, long, "en"), (4, "12 !", None), (5, long + " x", None)]
    docs = spark.createDataFrame([(*r, "s", None, 1, 2.0) for r in data], "doc_id long, text string, lang string, source string, n_chars long, c0 int, score double")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(0, "the old garden"), (0, long), (1, data[0][1]), (3, long)])
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
    nothing = spark.createDataFrame([(1, "words without language", None)], "doc_id long, text string, lang string")
    assert cp.language(spark, nothing, SF).count() == 1


def test_run(spark):
    found = cp.run(spark, SF).toPandas()
    assert found.columns.tolist() == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < len(found) < 200 and not found.doc_id.duplicated().any() and pd.notna(found.n_tokens).all()


def test_replacement_characters_of_a_document_stay(spark):
    import corpus_pipeline

    shared = "".join(chr(0x4E00 + 7 * k) for k in range(50))
    rows = [(1, "a\ufffdb " + shared), (2, "c\ufffdd " + shared + " e\ufffdf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert found == {1: rows[0][1], 2: "c\ufffdd e\ufffdf"}


def test_near_dedup_keeps_one_row_of_each_text(spark):
    """Rows that repeat an id are documents of their own; copies go, and what is unlike stays."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "y"), (2, b, "y"), (3, "short", "z"), (3, "short", "z"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = cp.near_dedup(spark, docs, SF)
    assert found.columns == docs.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[6], rows[7]]))
