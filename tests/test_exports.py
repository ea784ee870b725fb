"""Exports as files: named where they are written, by tasks, and not one for each thread."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemospark.plans import exports

DATA = "/root/testdata/sf0.001"


def _stored(path: str) -> list[str]:
    return sorted(os.path.relpath(os.path.join(top, f), path) for top, _, names in os.walk(path.removeprefix("file:")) for f in names if not f.startswith((".part", "_")) and not f.endswith(".crc"))


def test_notes_have_their_names_from_the_tasks(spark, monkeypatch):
    def no(*_):
        raise AssertionError("a file is renamed by the driver")

    monkeypatch.setattr(exports, "_renamed", no)
    (row,) = entry.queries()["s11_notes"](spark, DATA).collect()
    assert row.n == row.files - (row.files + 2) // 3 and row.all_known and row.some


def test_files_where_python_does_not_reach(spark, monkeypatch):
    rows = spark.createDataFrame([(v,) for v in ("a", "b\nc", None, "", "é")], "v string").repartition(2)
    found = []
    for direct in (True, False):
        monkeypatch.setattr(exports, "_direct", lambda path, direct=direct: direct)
        for named in (None, lambda i: f"{'even' if i % 2 == 0 else 'odd'}/n{i}.md"):
            path = exports._files(spark, rows, F.col("v"), "test-files", named)
            if named:
                assert _stored(path) == ["even/n0.md", "even/n2.md", "even/n4.md", "odd/n1.md", "odd/n3.md"]
            found.append(sorted(r.value for r in spark.read.text(path, wholetext=True, recursiveFileLookup=True).collect()))
    assert found == [sorted(["a\n", "b\nc\n", "\n", "\n", "é\n"])] * 4


def test_rows_in_another_order_give_the_same_files(spark):
    """A task that runs again gets its rows as the shuffle brings them."""
    rows = spark.range(40).select(F.col("id").alias("n"), F.struct(F.col("id").alias("key"), F.create_map(F.lit("k"), F.col("id")).alias("m")).alias("e"))
    found = []
    for order in (F.col("n"), F.desc("n")):
        path = exports._arrays(spark, rows.orderBy(order).coalesce(1), "test-arrays", 5).removeprefix("file:")
        found.append({name: open(f"{path}/{name}").read() for name in _stored(path)})
    assert found[0] == found[1] and len(found[0]) == 8


def test_an_attempt_that_dies_leaves_whole_files(tmp_path):
    class Dies:
        def __add__(self, _):
            raise ZeroDivisionError("an attempt that dies")

    name = lambda i: f"n{i}.txt"
    exports._writer(str(tmp_path), name)([("a", 0), ("b", 1)])
    with pytest.raises(ZeroDivisionError):
        exports._writer(str(tmp_path), name)([("a", 0), (Dies(), 1)])
    assert {p: (tmp_path / p).read_text() for p in os.listdir(tmp_path) if not p.startswith(".")} == {"n0.txt": "a\n", "n1.txt": "b\n"}


def test_posts_of_many_threads_share_a_file(spark, monkeypatch):
    seen = {}
    read = exports.items.read_own_posts
    monkeypatch.setattr(exports.items, "read_own_posts", lambda s, posts, comments: seen.update(posts=posts, comments=comments) or read(s, posts, comments))
    entry.queries()["s8_own_posts"](spark, DATA).collect()
    threads = spark.read.parquet(f"{DATA}/conversations.parquet").agg(F.max("conv_id")).first()[0] + 1
    assert all(len(_stored(path)) == -(-threads // 50) for path in seen.values())
