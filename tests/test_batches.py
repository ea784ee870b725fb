"""Searches hold few packed rows at a time, and leave the session's batches as they are."""

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.operators import approximate, search

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def test_batches_of_the_session_stay(spark):
    spark.conf.set(KEYS[0], "777")
    before = [spark.conf.get(k) for k in KEYS]
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, v array<float>")
    queries = vectors.limit(3).toDF("query_id", "qv")
    assert search.nearest(vectors, queries, 2).count() == 6
    assert [spark.conf.get(k) for k in KEYS] == before
    with pytest.raises(ZeroDivisionError), search.batches_of(spark, 5):
        1 / 0  # noqa: B018
    assert [spark.conf.get(k) for k in KEYS] == before
    spark.conf.unset(KEYS[0])


def test_candidates_are_passed_on(monkeypatch):
    """However many packs a task meets, it holds no more than so many scores."""
    monkeypatch.setattr(approximate, "HELD", 10)
    model = type("Shared", (), {"value": approximate.Model(np.ones((9, 4)), np.ones((1, 256, 4)), 1)})
    lists = lambda v: pa.array([v], pa.list_(pa.int64()))
    rows = [pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), lists([1, 2, 3]), pa.array([bytes([0, 1, 2])]), lists([7, 8]), pa.array([np.ones((2, 4)).tobytes()])], ["cell", "ids", "codes", "qids", "numbers"]) for c in range(9)]
    taken = iter(rows)
    first = next(approximate._candidates(model, 2)(taken))
    assert first.num_rows == 4 and len(list(taken)) == 6
    assert sum(b.num_rows for b in approximate._candidates(model, 2)(iter(rows))) == 9 * 4
