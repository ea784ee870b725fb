"""Arguments that are wrong fail loudly, and what is left out by default can be asked for."""

import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import approximate, facts, filters, reports, search
from mnemospark.session import clear_scratch, scratch
from mnemospark.sources import exports, items


def test_unknown_values(spark):
    rows = spark.createDataFrame([(1, "a", "note", None)], "item_id int, source string, kind string, updated_at timestamp")
    with pytest.raises(ValueError, match="no such kind"):
        filters.item_filter(rows, kinds=["song"])
    assert filters.item_filter(rows, kinds=["note"]).count() == 1
    assert filters.item_filter(rows, after="2024-01-01").count() == 0
    with pytest.raises(ValueError, match="mode"):
        search.search("fuzzy", rows, rows)
    obs = spark.createDataFrame([("m", datetime.date(2024, 1, 1))], "metric string, observed date")
    with pytest.raises(ValueError, match="at most"):
        filters.bounded_period(obs, since="2000-01-01")
    assert filters.bounded_period(obs).count() == 1
    with pytest.raises(ValueError, match="3650"):
        reports.history(obs, ["m"], "2000-01-01", "2024-01-01", ["observed"])
    with pytest.raises(ValueError, match="unknown metric"):
        exports.catalog(obs.select("metric"), spark.createDataFrame([("x", "y")], "alias string, metric string"))


def test_weeks_close_on_sunday_evening():
    week = lambda *now: facts.closed_week(datetime.datetime(*now))[:2]
    assert week(2024, 1, 21, 17) == ("2024-W02", datetime.date(2024, 1, 8))
    assert week(2024, 1, 21, 18) == ("2024-W03", datetime.date(2024, 1, 15))
    assert week(2024, 1, 22, 9) == ("2024-W03", datetime.date(2024, 1, 15))
    assert facts.closed_week(datetime.datetime(2024, 1, 1), "2026-W53")[1] == datetime.date(2026, 12, 28)


def test_caps_are_parameters(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("x" * 60_000)
    read = lambda **more: items.read_notes(spark, str(tmp_path), ["n"], **more).select(F.length("text")).first()[0]
    assert (read(), read(most=None)) == (50_000, 60_000)


def test_nearest_against_all_pairs(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(3000, 8)).round(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)
    asked = rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v AS qv")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.nearest(rows, asked, 5).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 3000, 20):
        score = np.round(unit @ unit[q], 6)
        assert [got[q, k + 1] for k in range(5)] == np.lexsort((np.arange(3000), -score))[:5].tolist()


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01", None])
def test_recall_of_codes(spark, monkeypatch, data):
    """Of the ten nearest vectors of each query 95 in a hundred are found, and each query reads under a tenth of them."""
    import numpy as np

    if data:
        rows = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id", "embedding AS v")
    else:  # no clusters at all, and cells in several blocks that are dealt over salts
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(2).normal(size=(3000, 8)))], "vec_id long, v array<double>")
        monkeypatch.setattr(approximate, "BLOCK", 16)
        monkeypatch.setattr(approximate, "TASK_BLOCKS", 2)
    asked = rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v AS qv")
    scored = lambda x: {(r.query_id, r.vec_id): r.score for r in x.collect()}
    exact = scored(search.nearest(rows, asked, 10))
    found = scored(approximate.nearest_by_codes(rows, asked, 10, approximate.fit(rows), rerank=rows.count() // 12))
    both = exact.keys() & found.keys()
    assert len(both) >= 0.95 * len(exact)
    assert all(abs(exact[p] - found[p]) < 2e-6 for p in both)


def test_codes_of_few_and_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [0.9, 0.1, 0.0]), (5, [-1.0, 0.0, 0.0])], "vec_id long, v array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, None)], "query_id int, qv array<float>")
    model = approximate.fit(rows)
    got = [(r.vec_id, r.score) for r in approximate.nearest_by_codes(rows, asked, 3, model).orderBy("rank").collect()]
    assert got == [(1, 1.0), (4, 0.993884), (2, 0.0)]
    assert approximate.fit(rows.limit(0)) is None and approximate.nearest_by_codes(rows.limit(0), asked, 3, None).count() == 0
    assert approximate.nearest_by_codes(rows, asked.limit(0), 3, model).count() == 0


def test_scratch_is_deleted(spark):
    path = scratch(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clear_scratch(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
