import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabkit.llm import bpe
from tabkit.llm.queries import QUERIES, VOCABULARY

TEXT = bpe.read_vocabulary(VOCABULARY)
LIBRARY = Tokenizer.from_str(TEXT)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ENCODER, DECODER = bpe.Encoder(TEXT), bpe.Decoder(TEXT)
ODD = [
    "", "  ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΑΣ ΟΔΟΣ σς",
    "Å é ﬁ ½² ٣ 12 don't DON'T we'll'''s", "\x1c\x1d a\x85b\xa0c　d​", "日本語テスト 漢字", "x" * 30000,
    "👍🏽 ok", "Ǆ ǅ ẞ ß K Å Ω", "Å é", "'sfoo 'S 'Re", "\x00\x01 \x7f\xad", "!!!'s !'s", "ab" * 5000,
]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    assert ENCODER.encode(ODD) == library(ODD)
    assert [DECODER.decode(i) for i in library(ODD)] == [LIBRARY.decode(i, skip_special_tokens=False) for i in library(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aàeèinthe'!?.<|>0123 \n\té²½ªºΣσ̈İı́ßÅ中😀\x1f\xa0\xad"), max_size=80))
def test_any_text(text):
    assert ENCODER.encode([text]) == library([text])


def test_words_by_plain_merges():
    rng = random.Random(3)
    trie = bpe.TrieEncoder(TEXT)
    words = {"".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    for word, pieces in trie.encode_words(words):
        assert pieces == trie.merge(trie.symbols(word + bpe.WORD_END))


def test_query_against_the_library(spark):
    rows = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = {}
    for (doc_id, _), ids in zip(rows, library([t for _, t in rows])):
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    got = QUERIES["op2_bpe"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@pytest.mark.parametrize("repeat", [1, 2])
def test_encode_then_decode(spark, repeat):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] * repeat + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(df, VOCABULARY)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.dropna().collect()) == sorted(list(enumerate(library(ODD))) * repeat)
    assert encoded.filter("doc_id IS NULL").first()["ids"] == []
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, VOCABULARY).collect()}
    assert all(decoded[i] == LIBRARY.decode(ids, skip_special_tokens=False) for i, ids in enumerate(library(ODD)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, VOCABULARY).count() == 0
    assert bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).count() == 0
