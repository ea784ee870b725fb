"""Each stage of the pipeline on what the one before kept, held against plain SQL and the tokenizer's library."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from mnemospark.llm import queries, sql
from mnemospark.llm.common import materialize, read_table

DATA = "/root/testdata/sf0.001"


def _sql(docs, text):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return {r[0]: r[1:] for r in con.execute(text).fetchall()}


def test_stages(spark):
    tiktoken = pytest.importorskip("tiktoken")
    docs, inputs = read_table(spark, DATA, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        docs = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == inputs[0].columns
            docs = materialize(docs, f"test-{i}")
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in inputs]
    kept = {r.doc_id for r in queries.graded(spark, inputs[0], DATA).where("kept").collect()}
    assert sorted(ids[1]) == sorted(kept) and len(kept) > 100
    groups = _sql(inputs[1], sql.ngram_jaccard(5, 80, 100))
    assert sorted(ids[2]) == sorted(d for d, (_, c) in groups.items() if d == c)
    left = _sql(inputs[2], sql.suffix_dedup())
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in inputs[3].collect()} == {d: x[3] for d, x in left.items()}
    taken = _sql(inputs[3], sql.source_mixing())
    assert sorted(ids[4]) == sorted(d for d, x in taken.items() for _ in range(x[3] // x[0] if x[0] else 0) if x[0])
    path, pattern = queries.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=queries.bpe.load_ranks(path), special_tokens={})
    want = sorted((r.doc_id, len(t := own.encode_ordinary(r.text)), hashlib.sha256(",".join(map(str, t)).encode()).hexdigest()) for r in inputs[4].collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect()) == want


def test_one_row_of_each_group(spark):
    long = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    near = long["a"] + " more"
    rows = [(5, near, "x"), (3, long["a"], "x"), (None, long["a"], "x"), (None, near, "x")]  # an id in the group: 3 stays
    rows += [(4, long["b"], "x"), (4, long["b"], "y"), (4, long["b"], "x")]  # repeated rows
    rows += [(None, long["c"], "x"), (None, long["c"], "y"), (None, long["c"] + " more", "x")]  # no id in the group
    rows += [(5, long["d"], "x")]  # another text of an id whose first text goes
    rows += [(6, long["e"], "x"), (6, long["f"], "x"), (7, long["g"], "x"), (7, long["g"] + " more", "x")]
    rows += [(8, "", "x"), (8, "", "x"), (9, None, "x"), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()]
    want = [(3, "a"), (4, "b"), (5, "d"), (6, "e"), (6, "f"), (7, "g"), (8, ""), (9, ""), (None, ""), (None, "c")]
    assert sorted(((d, (t or "")[:1]) for d, t, _ in kept), key=str) == sorted(want, key=str)
    assert all(r in rows for r in kept) and (4, long["b"], "x") in kept
