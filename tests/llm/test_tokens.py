import base64
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from helpers import sha
from tokenizers import Tokenizer

from postflow.llm import bpe, tokenfiles

BPE, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    pieces = ["the ", "Thing", "é", "ß", "中文", " \n", "  ", "12", "'s", "\x00", "aaaa", "ing", "😀", "<|endoftext|>"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["a" * 3000, "ab" * 700, "x y" * 90]


def test_merges_like_the_library(plain):
    coder = bpe.Coder(BPE, P.PATTERN)
    texts = odd_texts()
    found = coder.encode_all(texts)
    assert found == [plain.encode_ordinary(t) for t in texts]
    assert [coder.decode(ids) for ids in found] == [t.encode() for t in texts]
    for t in texts:  # the scalar way, without the memo
        for piece in coder.split(t):
            assert bpe.merge(piece.encode(), coder.ranks) == plain.encode_ordinary(piece)


def test_memo_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    coder = bpe.Coder(BPE, P.PATTERN)
    for t in odd_texts()[:40]:
        assert coder.encode(t) == plain.encode_ordinary(t)


def test_frames(spark, table, prose, plain):
    docs = table([*prose, (None, "no id"), (3, prose[3][1])])
    found = bpe.digest(docs, BPE, P.PATTERN).toPandas()
    assert len(found) == len(prose) + 2
    texts = dict(prose)
    for r in found.itertuples():
        t = "no id" if pd.isna(r.doc_id) else texts[int(r.doc_id)] or ""
        ids = plain.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    decoded = bpe.decode(bpe.encode(docs.filter("doc_id = 5"), BPE, P.PATTERN), BPE, P.PATTERN).first()
    assert bytes(decoded.decoded).decode() == texts[5] and list(decoded.ids) == plain.encode_ordinary(texts[5])
    assert bpe.digest(docs.limit(0), BPE, P.PATTERN).count() == 0


def test_words_are_encoded_like_whole_texts():
    tokenizer = Tokenizer.from_file(WORD)
    texts = [*odd_texts(), "É é ́x", "İI ΑΣ ς", "a b c", "", "don't we'll"]
    offsets, ids = tokenfiles.encode_words(pa.array(texts, pa.string()), WORD)
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in whole]


def test_a_word_is_encoded_once_whatever_follows_it(monkeypatch):
    tokenizer, coder, new = Tokenizer.from_file(WORD), tokenfiles.Encoder(WORD), []
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda terms: [new.extend(str(t) for t in terms), encode(terms)][1])
    monkeypatch.setattr(tokenfiles.tx, "kept", lambda name, make: coder)
    texts = ["él né. né, né", "né! él? İ. İ", "né: é́. ß; 文. ×."]
    for _ in range(2):
        offsets, ids = tokenfiles.encode_words(pa.array(texts), WORD)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sorted(new) == sorted(["él", "né", ".", ",", "!", "?", ":", ";", "İ.", "İ", "é́.", "ß", "文", "×."])


def test_remembered_words_are_bounded(monkeypatch):
    tokenizer, coder = Tokenizer.from_file(WORD), tokenfiles.Encoder(WORD)
    monkeypatch.setattr(tokenfiles, "MEMO_WORDS", 8)
    monkeypatch.setattr(tokenfiles.tx, "kept", lambda name, make: coder)
    for k in range(6):
        texts = [f"the new thing {'x' * k} w{k} 文{k}", None, f"thing{k}. Old"]
        offsets, ids = tokenfiles.encode_words(pa.array(texts), WORD)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(coder.terms) <= 8
    assert {"the", "new", "thing"} <= set(coder.terms.to_pylist())


def test_token_files(spark, table, prose, tmp_path, monkeypatch):
    docs = table([*prose, (None, "no id")])
    coded = tokenfiles.token_ids(docs, WORD, 2)
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 300)
    path = str(tmp_path / "files")
    tokenfiles.write_files(coded, path, 2, 4)
    found = tokenfiles.checksums(tokenfiles.read_files(spark, path)).toPandas().sort_values("start")
    tokenizer, start = Tokenizer.from_file(WORD), 0
    assert [None if pd.isna(i) else int(i) for i in found.doc_id] == [None, *range(len(prose))]
    for r, t in zip(found.itertuples(), ["no id", *[t for _, t in prose]]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert spark.read.parquet(f"{path}/blocks").count() > 4


def test_common_ids_take_one_byte(spark, table, prose, tmp_path):
    coded = tokenfiles.token_ids(table(prose), WORD, 2)
    order = tokenfiles.ranked_ids(coded, 2)
    counts = np.bincount(np.concatenate([np.frombuffer(r.ids, "<u4") for r in coded.collect()]))
    assert list(order) == sorted(np.flatnonzero(counts), key=lambda i: (-counts[i], i))


def test_no_documents(spark, table, tmp_path):
    coded = tokenfiles.token_ids(table([]), WORD, 2)
    tokenfiles.write_files(coded, str(tmp_path / "f"), 2, 3)
    assert tokenfiles.read_files(spark, str(tmp_path / "f")).count() == 0


def test_a_broken_file_is_refused():
    with pytest.raises(ValueError):
        tokenfiles.read_payload(b"nothing")
