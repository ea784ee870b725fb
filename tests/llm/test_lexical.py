"""Ranked lexical search against brute force, its SQL and odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from mnemospark.llm import lexical, queries, sql

WORD = re.compile(lexical.WORD)
LOWER = str.maketrans(lexical._UPPER, lexical._LOWERED)


def brute(docs, items, k):
    cut = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    n, total = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    df, out = Counter(t for _, w in cut for t in set(w)), []
    counted = [(d, Counter(w), len(w)) for d, w in cut]
    for item, text in dict.fromkeys(items):
        terms, scored = WORD.findall((text or "").translate(LOWER)), []
        for d, tf, size in counted:
            m = 75 + (25 * size * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -score) for i, (score, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(found):
    return sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def some(seed, n_docs, n_items, words=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    text = lambda n: " ".join(rng.choices(names, [1 / (i + 1) for i in range(words)], k=n))
    return [(i, text(rng.randrange(40))) for i in range(n_docs)], [(i, text(rng.randrange(1, 9))) for i in range(n_items)]


@pytest.mark.parametrize(("owners", "block", "k"), [(1, 4096, 5), (3, 16, 3), (4, 7, 20), (6, 50, 1)])
def test_brute_force(spark, monkeypatch, owners, block, k):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = some(owners, 180, 25)
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, owners=owners)
    assert rows(found) == brute(docs, items, k)


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 20)
    docs, items = some(9, 80, 12)
    assert rows(lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)) == brute(docs, items, 4)


def test_pruned_accumulators_are_few(spark):
    """A block in which k documents hold a rare term sends no more than those on to the owner of the common ones."""
    import numpy as np

    items = lexical.Items([["rare", "common"]])
    df = {items.names.index("rare"): 4, items.names.index("common"): 3000}
    items.deal(4096, df, {t: 1 for t in df}, 2)
    none = np.zeros(0, np.int64)
    bundle = {"items": none, "sizes": none, "open": none, "docs": none, "scores": none}
    t = items.names.index("rare")
    held = {"terms": np.array([t]), "df": np.array([4]), "docs": np.arange(4), "tf": np.ones(4, np.int32)}
    (after,) = lexical._visit(bundle, held, items, 0, np.full(4096, 100), 3)
    assert list(after[1]) == [0, 1, 2, 3] and not after[3]


def test_sql_over_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert rows(queries.QUERIES["op12_ranked_search"](spark, d)) == sorted(con.sql(sql.ORACLE_SQL["op12_ranked_search"]).fetchall(), key=str)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "Été ÉTÉ x-ray 日本"), (3, "Été ÉTÉ x-ray 日本"), (None, "x ray X"), (4, "ray " * 40_000), (5, "!!! ---")]
    items = [(1, "X ray"), (1, "X ray"), (1, "日本 Été"), (2, None), (None, "ray"), (3, "?!"), (4, "nowhere")]
    given = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS block", "1 AS terms", "2 AS item")
    found = lexical.rank(given, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'b' AS doc_id"), 3)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == brute(docs, items, 3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.rank(given.limit(0), asked)) == [] == rows(lexical.rank(given, asked.limit(0)))
    with pytest.raises(ValueError, match="k and owners"):
        lexical.rank(given, asked, 0)
