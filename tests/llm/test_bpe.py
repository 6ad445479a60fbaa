from __future__ import annotations

import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import bpe, queries
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def real():
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(queries.VOCABULARY)))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.model(queries.vocabulary())


def expected(real, text):
    ids = real.encode(text or "", add_special_tokens=False).ids
    return len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(real.decode(ids, skip_special_tokens=False))


def as_list(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_query(spark, sf_dir, real):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_list(queries.op7_bpe(spark, sf_dir)) == sorted(((d, *expected(real, t)) for d, t in docs), key=str)


def test_edges(spark, real):
    for rows in (edge_rows(), with_nulls()):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert as_list(bpe.digests(docs, queries.vocabulary())) == sorted(((r[0], *expected(real, r[1])) for r in rows), key=str)
    assert bpe.digests(docs.limit(0), queries.vocabulary()).count() == 0


def test_encode_and_decode_columns(spark, real):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    v = queries.vocabulary()
    out = bpe.decode(bpe.encode(docs, v), v).collect()
    for r in out:
        ids = real.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == real.decode(ids, skip_special_tokens=False)


SAMPLES = ["", " ", "Hello, WORLD's best!!", "ΑΣ ς Σ", "İstanbul ı ſ K", "a\u0301 \u212b ﬁ", "\x00\x01\x1c\x1d\x85\u2028\u3000x", "<|startoftext|>Hi<|endoftext|> there <|endoftext|", "<|STARTOFTEXT|>", "12345 ½ ² Ⅳ ٣", "'S'T 'LL don'T", "\U0001f600\U0001f468\u200d\U0001f469", "ǅ ǆ ß ẞ", "日本語テキスト", "\ufeff\u200b\u00ad", "ｆｕｌｌ", "e\u0327\u0301"]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(own, real, text):
    ids = real.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.digest(text)[:2] == (len(ids), " ".join(map(str, ids)))
    assert own.digest(text)[2] == real.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, real, text):
    assert own.encode(text) == real.encode(text, add_special_tokens=False).ids


def test_long_words(own, real):
    r = random.Random(8)
    for n in (100, 1000, 20_000):
        for letters in ("a", "ab", "the", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(r.choice(letters) for _ in range(n))
            assert own.encode(word) == real.encode(word, add_special_tokens=False).ids


def test_a_missing_library_is_an_error(monkeypatch):
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    with pytest.raises(ImportError):
        bpe.BPE(queries.vocabulary())


def test_files_that_ask_for_something_else_are_refused():
    import json

    good = json.loads(queries.vocabulary())
    bpe.check_supported(good)
    for part, value in (("decoder", {"type": "ByteLevel"}), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}), ("pre_tokenizer", None), ("model", good["model"] | {"byte_fallback": True})):
        with pytest.raises(ValueError, match=part):
            bpe.check_supported(good | {part: value})
