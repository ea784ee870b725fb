"""What the n-gram join writes grows with its input, also where all documents share an n-gram."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import ngram_join


def common_gram(low):
    """Three words whose hash lies just above the lowest part of all hashes."""
    for i in itertools.count():
        words = f"a{i} b{i} c{i}"
        values, _ = ngram_join.sets(pa.array([words]), 3)
        if low < values[0] / 2**64 < low + 0.01:
            return words


@pytest.mark.parametrize("words", [8, 60])
def test_rows_of_the_second_round(spark, monkeypatch, words):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    written = {}
    materialize = ngram_join.materialize

    def counting(df, name):
        found = materialize(df, name)
        written[name] = written.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(ngram_join, "materialize", counting)
    gram, rows = common_gram(1 / ngram_join.LOW), []
    for n in (300, 1200):
        written.clear()
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(gram + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string"))), " ")).alias("text"))
        found = ngram_join.join_components(docs)
        assert found.where("component_id <> doc_id").count() == 0 and found.count() == n
        rows.append(written.get("again", 0))
    assert rows[1] <= 4 * max(rows[0], 64), rows


def test_hot_grams_of_whole_prefixes_are_counted(spark):
    gram = common_gram(0.4)
    docs = spark.range(100).select(F.concat(F.lit(gram + " "), F.concat_ws(" ", F.lit("x"), "id", F.lit("y"), "id")).alias("text"))
    values, _ = ngram_join.sets(pa.array([gram]), 3)
    found, counts = ngram_join.hot_elements(docs, "text", 3, 90, 100)
    assert counts[np.searchsorted(found, values[0])] == 100
