"""Streams over pages behind a cursor, trees of files, and rows that come again or are corrected late."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import store, upkeep
from mnemospark.streaming import feeds, sources


def land(path, folder, rows, size=3):
    """Rows as pages from new to old."""
    os.makedirs(path / folder)
    rows = sorted(rows, key=lambda r: r["createdAt"] or "", reverse=True)
    for i in range(0, len(rows), size):
        (path / folder / f"page-{i:04d}.json").write_text(json.dumps({"bookmarks": rows[i : i + size]}))


def bookmark(i, day, title="t"):
    return {"id": i, "createdAt": f"2024-01-{day:02d}", "title": f"{title}{i}"}


def record(rows):
    title = F.get_json_object("row", "$.title")
    return rows.select(F.col("id").cast("long").alias("item_id"), F.lit("b").alias("source"), F.lit("bookmark").alias("kind"), title.alias("title"), F.lit(None).cast("string").alias("url"), title.alias("text"))


def taken(spark, path, checkpoint):
    """Ids of each batch that a run from the checkpoint takes."""
    sources.register(spark)
    found = []
    feed = spark.readStream.format("landed_pages").options(path=str(path), rows="bookmarks").load()
    sources._run(feed, str(checkpoint), lambda batch, n: found.append(sorted(int(r.id) for r in batch.collect())))
    return [f for f in found if f]


def test_cursor_and_boundary(spark, tmp_path):
    pages, mark = tmp_path / "pages", tmp_path / "mark"
    assert taken(spark, pages, mark) == []
    first = [bookmark(i, i) for i in range(1, 9)]
    land(pages, "0001", first)
    assert taken(spark, pages, mark) == [list(range(1, 9))]
    assert taken(spark, pages, mark) == []  # nothing new: the offset is the same
    # Two more share the cursor's day, two are newer; of the rest nothing comes again.
    land(pages, "0002", [*first, bookmark(20, 8), bookmark(21, 8), bookmark(30, 9), bookmark(31, 10)])
    assert taken(spark, pages, mark) == [[8, 20, 21, 30, 31]]


def test_pages_before_the_boundary_alone(spark, tmp_path):
    land(tmp_path, "0001", [bookmark(i, i) for i in range(1, 25)])
    stream = sources._PageStream({"path": str(tmp_path), "rows": "bookmarks"})
    end = stream.latestOffset()
    assert end == {"folder": "0001", "cursor": "2024-01-24"}
    assert [len(p.paths) for p in stream.partitions(stream.initialOffset(), end)] == [8]
    parts = stream.partitions({"folder": "0000", "cursor": "2024-01-21"}, end)
    assert [os.path.basename(path) for p in parts for path in p.paths] == ["page-0000.json", "page-0003.json"]
    assert [r[1] for p in parts for r in stream.read(p)] == ["2024-01-24", "2024-01-23", "2024-01-22", "2024-01-21"]


def test_pages_into_the_archive(spark, tmp_path):
    own, pages = upkeep.Archive(spark, str(tmp_path / "archive"), buckets=2), {"path": str(tmp_path / "pages"), "rows": "bookmarks"}
    first = [bookmark(i, i) for i in range(1, 6)]
    land(tmp_path / "pages", "0001", first)
    assert sources.sync_pages(own, pages, str(tmp_path / "mark"), record) == {"rows": 5, "inserted": 5, "updated": 0, "skipped": 0, "pruned": 0}
    land(tmp_path / "pages", "0002", [*first[1:4], bookmark(5, 5, "new"), bookmark(6, 6)])
    with pytest.raises(Exception, match="lost"):
        sources.sync_pages(own, pages, str(tmp_path / "mark"), lambda rows: (_ for _ in ()).throw(OSError("lost")))
    # The cursor stands where it was: the boundary and what is new come, and the sweep takes away what is gone.
    assert sources.sync_pages(own, pages, str(tmp_path / "mark"), record, full=True) == {"rows": 2, "inserted": 1, "updated": 1, "skipped": 5, "pruned": 1}
    assert sorted(r.title for r in own.store.read("items").collect()) == ["new5", "t2", "t3", "t4", "t6"]


def test_files_that_grow_in_place(spark, tmp_path):
    tree, states = tmp_path / "tree", store.Store(spark, str(tmp_path / "states"))
    os.makedirs(tree / "a" / "b")
    for name, text in (("x.jsonl", "1"), ("a/y.jsonl", "1"), ("a/b/z.jsonl", "1"), ("a/no.txt", "1")):
        (tree / name).write_text(text)
    run = lambda **more: {os.path.relpath(r.path, tree): r.action for r in sources.sync_files(states, {"path": str(tree), "suffix": ".jsonl", **more}, str(tmp_path / "mark")).collect()}
    assert run() == {"x.jsonl": "insert", "a/y.jsonl": "insert", "a/b/z.jsonl": "insert"}
    assert run() == {}
    (tree / "a/y.jsonl").write_text("12")
    old = tree / "moved.jsonl"
    old.write_text("1")
    os.utime(old, (1_000_000, 1_000_000))
    assert run(margin_hours="1") == {"a/y.jsonl": "update"}  # the margin passes over what moved in with an old time
    assert run() == {"moved.jsonl": "insert"}


def test_same_file_a_year_later(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 2), ("b", "2024-01-02", 2)], "k string, day string, v int")
    feed = lambda: feeds.first_ever(feeds.landed(spark, str(tmp_path / "in"), rows.schema), ["k", "day"])
    found = []
    for more in (rows, rows, rows.unionAll(spark.createDataFrame([("a", "2025-01-01", 1)], rows.schema))):
        more.write.mode("append").parquet(str(tmp_path / "in"))
        sources._run(feed(), str(tmp_path / "mark"), lambda batch, n: found.append(sorted(tuple(r) for r in batch.collect())))
    assert [f for f in found if f] == [[("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], [("a", "2025-01-01", 1)]]


def test_late_corrections_change_sums(spark, tmp_path):
    schema = "id long, supersedes long, day string, v double"
    batches = [
        [(1, None, "d1", 10.0), (2, None, "d1", 5.0), (4, 3, "d2", 7.0)],  # 4 corrects what has not come yet
        [(3, None, "d2", 100.0), (5, 1, "d1", 11.0), (1, None, "d1", 10.0)],
        [(6, 5, "d3", None), (5, 1, "d1", 11.0), (2, None, "d1", 5.0)],
    ]
    sums, total = [], {}
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        feed = feeds.corrections(feeds.landed(spark, str(tmp_path / "in"), schema), ["day", "v"])

        def add(batch, n):
            for r in batch.collect():
                total[r.day] = total.get(r.day, 0) + r.sign * (r.v or 0)

        sources._run(feed, str(tmp_path / "mark"), add)
        sums.append({d: v for d, v in total.items() if v})
    assert sums == [{"d1": 15.0, "d2": 7.0}, {"d1": 16.0, "d2": 7.0}, {"d1": 5.0, "d2": 7.0}]


def test_standing_rows_need_no_python(spark, tmp_path):
    """What counts after corrections that come before, after and again; state is Spark's own."""
    schema, rows = "id long, supersedes long, v double", {}
    for batch in ([(2, 1, 20.0), (4, None, 4.0)], [(1, None, 1.0), (4, None, 4.0), (5, 4, None)], [(2, 1, 20.0), (1, None, 1.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = feeds.standing(feeds.landed(spark, str(tmp_path / "in"), schema), ["v"])
        assert "Python" not in feed._jdf.queryExecution().logical().toString()
        sink = lambda found, n: rows.update({r.id: (r.come, r.gone, r.v) for r in found.collect()})
        feed.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    assert rows == {1: (True, True, 1.0), 2: (True, False, 20.0), 4: (True, True, 4.0), 5: (True, False, None)}
