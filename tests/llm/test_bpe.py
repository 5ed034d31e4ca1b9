"""Byte-pair encoding against the tokenizers library."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


ODD = (
    "", "   ", "Hello  world's ÀÉΣΟΣ x<|endoftext|>y <|startoftext|>|> don't 123", "\x1c\x85᠎​ z a", "İstanbul ǅ ﬁ Ⅷ ½ ²", "é a<|endoftext|>́b", "<|endoftext|><|startoftext|>",
    "<|endoftext|", "漢字かな交じり文 한국어", "🙂🙃 👩‍👩‍👧", "a" * 5000, "ab" * 700 + "é" * 500, "\x00\x01", "it'S we'LL '", "x'd'd'd", "١٢٣ १२३", "ß ẞ ŉ",
)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, vocabulary, text):
    ids = ids_of(library, text)
    body = vocabulary.encode(text)
    assert list(struct.unpack(f"<{len(body) // 4}I", body)) == ids
    assert vocabulary.decode(body) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinthsro 'SÀé́Σ<|>.\n"), st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), max_size=80))
def test_random_texts(library, vocabulary, text):
    body = vocabulary.encode(text)
    assert list(struct.unpack(f"<{len(body) // 4}I", body)) == ids_of(library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinthsrolng", min_size=1, max_size=200))
def test_heap_equals_scan(vocabulary, word):
    symbols = word + bpe.END
    bounds = [*range(len(word)), len(symbols)]
    assert bpe._heaped(symbols, list(bounds), vocabulary.ranks) == bpe._scanned(symbols, list(bounds), vocabulary.ranks)


def test_long_word_is_encoded_whole(library, vocabulary):
    word = "thering" * 40_000
    body = vocabulary.encode(word)
    assert list(struct.unpack(f"<{len(body) // 4}I", body)) == ids_of(library, word)


def test_query(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op13_bpe(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ids_of(library, docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, None, 1), (2, "the cat", 2), (2, "the cat", 2), (3, "", 3), (4, "long text " * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    tokens = bpe.encoded(df, PATH)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in tokens.collect()) == [(0, 0), (1, 0), (2, 8), (2, 8), (3, 0), (4, 1_600_000)]
    assert [r.decoded for r in bpe.decoded(tokens.where("doc_id = 2"), PATH).collect()] == ["the</w> cat</w>"] * 2
    empty = df.limit(0)
    assert bpe.op13_digests(empty, PATH).count() == 0 and bpe.decoded(bpe.encoded(empty, PATH), PATH).count() == 0


def test_oversized_vocabulary_is_refused(spark, tmp_path, monkeypatch):
    path = tmp_path / "big.json"
    path.write_bytes(b" " * 100)
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 50)
    with pytest.raises(ValueError, match="bytes"):
        bpe.encoded(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), str(path))
