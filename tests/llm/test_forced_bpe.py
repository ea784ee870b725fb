"""Encoding by forced boundaries against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import forced_bpe, queries

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\xa0", "\x85", "\u3000", "'s", "'", "'ll", "!", "<|endoftext|>", "<|endoftext", "日本", "é", "à", "🎉", "1", "٣", "Ⅷ", "\x1c", "\x00", "ſ", "ing", "ª", "\u088f", "\U00033036"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.byte_tokenizer())


@pytest.fixture(scope="module")
def own():
    return forced_bpe.Encoder(forced_bpe.Vocabulary(queries.byte_tokenizer()))


def check(own, library, texts):
    for text, found in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(found, "<i4")
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text[:80]
        assert own.decode(ids, np.array([0, len(ids)])) == [library.decode(ids.tolist(), skip_special_tokens=False)]


def test_random_texts(own, library):
    rng = random.Random(3)
    check(own, library, ["".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(3000)])
    check(own, library, ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0x300), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(10))) for _ in range(2000)])


def test_long_fragments(own, library):
    rng = random.Random(4)
    check(own, library, ["a" * 20000, "".join(rng.choices("ab", k=9000)), "".join(rng.choices("etaoins", k=20000)), "theof" * 3000, " " * 3000 + "x", "\n" * 1000, "x" * 256, "x" * 257])


def test_strings_of_added_tokens(own, library):
    text = "a<|endoftext|> b <|endoftext|><|endoftext|>"
    assert np.frombuffer(own.encode([text])[0], "<i4").tolist().count(50256) == 3
    library.encode_special_tokens = True
    try:
        assert np.frombuffer(own.encode([text], plain=True)[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False


def test_decode_of_any_ids(own, library):
    ids = np.array([0, 160, 50256, 220, 126, 105], "<i4")
    assert own.decode(ids, np.array([0, 3, 3, 6])) == [library.decode(ids[:3].tolist(), skip_special_tokens=False), "", library.decode(ids[3:].tolist(), skip_special_tokens=False)]
    assert own.decode(np.array([-1, 64, 99999], "<i4"), np.array([0, 3])) == ["a"]


def test_no_token_spans_a_forced_boundary(own, library):
    text = "naïve 日本語 qzxq'jj"
    cuts = set(np.flatnonzero(own.v.forced(np.frombuffer(text.encode(), np.uint8))).tolist())
    ends = set(np.cumsum([len(own.v.tokens[i]) for i in library.encode(text, add_special_tokens=False).ids]).tolist())
    assert cuts - {0} <= ends


def test_rows_of_the_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_forced_bpe"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows(spark, library):
    given = [(1, None, "a"), (2, "", None), (3, "x  y", "b"), (3, "x  y", "b"), (None, "word " * 40_000, "c")]
    df = spark.createDataFrame(given, "doc_id long, text string, ids string").withColumn("was", F.col("text"))
    rows = forced_bpe.encode(df, queries.byte_tokenizer(), back=True).collect()
    assert len(rows) == len(given) and set(rows[0].asDict()) == {"doc_id", "was", "ids", "decoded"}
    for r in rows:
        assert list(r.ids) == library.encode(r.was or "", add_special_tokens=False).ids and r.decoded == (r.was or "")
    assert forced_bpe.encode(df.limit(0), queries.byte_tokenizer()).count() == 0
