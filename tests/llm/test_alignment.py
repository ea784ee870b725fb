"""Alignment of two tokenizers against a plain version over the libraries."""

import hashlib
import random
from collections import Counter

import pytest

from mnemospark.llm import alignment, queries

PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "!", "<s>", "<|endoftext|>", "日本", "é", "🎉", "12", "▁", "\x00", "ing", "tionhend", "①", "﻿", "qzx", "and", "of"]


@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(queries.byte_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.piece_tokenizer())


def brute(libraries, docs):
    from mnemospark.llm.forced_bpe import byte_letters

    a, b = libraries
    letter, groups = byte_letters(), []
    for _, text in docs:
        own = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if all(b"".join(r) == (" " + text).encode() for r in raw):
                x, y, p, q, size = [], [], 0, 0, [0, 0]
                while p < len(ids[0]) or q < len(ids[1]):
                    if size[0] <= size[1] and p < len(ids[0]):
                        x.append(ids[0][p])
                        size[0], p = size[0] + len(raw[0][p]), p + 1
                    else:
                        y.append(ids[1][q])
                        size[1], q = size[1] + len(raw[1][q]), q + 1
                    if size[0] == size[1]:
                        own.append((x, y))
                        x, y = [], []
        groups.append(own)
    links = [Counter((i, j) for x, y in g for i in x for j in y) for g in groups]
    count = Counter(pair for c in links for pair in c)
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, _), g, c in zip(docs, groups, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        measures = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()))
        out.append((doc, *measures, hashlib.sha256(written.encode()).hexdigest() if g else "", written))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest", "groups"]


def rows(found):
    return sorted([tuple(r) for r in found.select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize("block", [1_500_000, 30])
def test_brute_force(spark, libraries, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 400)
    rng = random.Random(block)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(120)]
    docs = [(i, rng.choice(texts)) for i in range(300)]
    found = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), queries.byte_tokenizer(), queries.piece_tokenizer(), with_groups=True)
    assert rows(found) == brute(libraries, docs)


def test_odd_rows(spark, libraries):
    docs = [(1, None), (2, ""), (3, "x  y"), (3, "x  y"), (None, "word " * 40_000), (5, "▁x"), (6, "x"), (7, "x"), (8, " ")]
    given = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS block", "3 AS pairs", "'a' AS doc")
    found = alignment.align(given, queries.byte_tokenizer(), queries.piece_tokenizer(), with_groups=True)
    assert rows(found) == brute(libraries, docs)
    assert alignment.align(given.limit(0), queries.byte_tokenizer(), queries.piece_tokenizer()).count() == 0


def test_rows_of_the_query(spark, libraries):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = queries.QUERIES["op11_alignment"](spark, d)
    assert found.columns == [*COLUMNS[:-2], "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == [r[:-1] for r in brute(libraries, docs)]
