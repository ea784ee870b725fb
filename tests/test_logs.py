"""Session logs on small files typed here."""

import json

from pyspark.sql import functions as F

from mnemospark.operators import maintenance, reports
from mnemospark.sources import logs


def _write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_sessions(spark, tmp_path):
    def said(kind, content, **more):
        return {"type": kind, "sessionId": "s", "cwd": "/c", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": content}, **more}

    rows = [{"type": "summary", "summary": "old"}, said("user", "hello\nthere"), "no json {", said("user", "<command-name>x"), said("assistant", [{"type": "text", "text": " a "}, {"type": "tool_use", "id": 1}, {"type": "text", "text": "b"}]), said("user", "side", isSidechain=True), said("user", [{"type": "tool_result"}]), {"type": "summary", "summary": "new"}]
    _write(tmp_path / "a.jsonl", rows)
    _write(tmp_path / "b.jsonl", [said("user", "only", sessionId=None)])
    found = logs.read_sessions(spark, str(tmp_path / "*.jsonl")).collect()
    assert sorted((r.conv_id.rsplit("/")[-1], r.title, r.position, r.role, r.text, r.cwd) for r in found) == [("b.jsonl", "only", 0, "user", "only", "/c"), ("s", "new", 0, "user", "hello\nthere", "/c"), ("s", "new", 1, "assistant", "a\nb", "/c")]
    assert [r.n for r in logs.bad_lines(spark, str(tmp_path / "*.jsonl")).collect()] == [1]


def test_rollouts(spark, tmp_path):
    def item(role, text):
        return {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}

    rows = [{"type": "session_meta", "payload": {"id": "m", "cwd": "/d"}}, item("developer", "x"), item("user", "<environment_context>y"), item("user", logs.EDITOR + "\nfiles\n" + logs.REQUEST + "\ndo it"), item("assistant", "done"), {"type": "response_item", "payload": {"type": "reasoning"}}]
    _write(tmp_path / "c.jsonl", rows)
    assert [(r.conv_id, r.title, r.role, r.text, r.cwd) for r in logs.read_rollouts(spark, str(tmp_path / "c.jsonl")).orderBy("position").collect()] == [("m", "do it", "user", "do it", "/d"), ("m", "do it", "assistant", "done", "/d")]


def test_titles(spark):
    rows = spark.createDataFrame([(1, "The plan: on Spark joins, Spark"), (2, " "), (3, "要約の作成"), (4, None)], "i int, title string")
    assert [r.q for r in reports.title_queries(rows, "i").orderBy("place").collect()] == ["The plan: on Spark joins, Spark", "plan", "Spark", "joins", "要約の作成", "要約", "作成"]


def test_file_states(spark):
    listing = spark.createDataFrame([("a/1", 1, 5), ("a/2", 2, 5), ("b/3", 3, 5)], "path string, size long, modified long")
    state = spark.createDataFrame([("a/1", 1, 5), ("a/2", 1, 5), ("b/3", 3, 5)], "path string, size long, modified long")
    assert [r.path for r in maintenance.changed_files(listing, state).collect()] == ["a/2"]
    assert sorted(r.path for r in maintenance.changed_files(listing, maintenance.forgotten(state, "b/")).collect()) == ["a/2", "b/3"]
    runs = spark.createDataFrame([("r", 1, "running"), ("r", 2, "ok"), ("q", 1, "running")], "run string, at int, status string")
    assert [r.run for r in maintenance.latest_states(runs, "run", "at").where(F.col("status") == "running").collect()] == ["q"]
