"""Readers on small files typed here."""

import datetime
import json

from mnemospark.sources import items, measurements

METRICS = [("alt", "U/L", None), ("weight", "kg", "BodyMass"), ("sleep", "min", measurements.SLEEP)]


def _catalog(spark):
    metrics = spark.createDataFrame(METRICS, "metric string, canonical_unit string, type string")
    aliases = spark.createDataFrame([("Alanine", "alt"), ("ALT", "alt"), ("weight", "weight")], "alias string, metric string")
    return metrics, aliases, spark.createDataFrame([("U/L", "U/L"), ("IU/L", "U/L"), ("kg", "kg"), ("lb", "lb")], "spelling string, unit string")


def test_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("metric,abbr,unit,reference,2024-01-05,2/1/2024\nAlanine,,IU/L,5-45,\"1,020\",\nwho,ALT,mg,,12,<5\nnone,,,,3\nweight,,kg,,70,71,72\n")
    got = {(r.original_metric, str(r.observed)): (r.metric, r.value_num, r.value_text, r.unit, r.quality, r.reference_low, r.reference_high, r.reason) for r in measurements.read_sheet(spark, str(tmp_path / "a.csv"), *_catalog(spark)).collect()}
    assert got == {
        ("Alanine", "2024-01-05"): ("alt", 1020.0, None, "U/L", "valid", 5.0, 45.0, None), ("who", "2024-01-05"): ("alt", None, "12", None, "provisional", None, None, None),
        ("who", "2024-02-01"): ("alt", None, "<5", None, "valid", None, None, None), ("none", "2024-01-05"): (None, 3.0, None, None, "valid", None, None, "unknown_metric"),
        ("weight", "2024-01-05"): ("weight", 70.0, None, "kg", "valid", None, None, "too_many_cells"), ("weight", "2024-02-01"): ("weight", 71.0, None, "kg", "valid", None, None, "too_many_cells"),
    }


def test_records(spark, tmp_path):
    def record(kind, value, unit, start, end):
        return f'<Record type="{kind}" sourceName="s" unit="{unit}" value="{value}" startDate="{start}" endDate="{end}"/>'

    day, later = "2024-01-05 01:00:00 +0900", "2024-01-05 01:30:00 +0900"
    rows = [record("BodyMass", "70", "kg", day, day)] * 2 + [record("BodyMass", "150", "lb", day, later), record(measurements.SLEEP, "Asleep", "", day, later), record("BodyMass", "1", "kg", "1970-01-01 00:00:00 +0000", ""), record("Steps", "5", "count", day, day)]
    (tmp_path / "e.xml").write_text("<Data>\n" + "\n".join(rows) + "\n</Data>")
    metrics, _, units = _catalog(spark)
    got = sorted((r.metric, r.value_num or 0, r.value_text or "", r.unit or "", r.quality, r.precision, str(r.observed), r.reason or "") for r in measurements.read_records(spark, str(tmp_path / "e.xml"), metrics, units).collect())
    assert got[1:] == [("weight", 0, "150", "", "provisional", "interval", "2024-01-05", ""), ("weight", 1.0, "", "kg", "valid", "interval", "1970-01-01", "sentinel_date"), ("weight", 70.0, "", "kg", "valid", "instant", "2024-01-05", "")]
    assert got[0] == ("sleep", 30.0, "Asleep", "min", "valid", "interval", "2024-01-05", "")
    assert [tuple(r) for r in measurements.ignored_types(spark, str(tmp_path / "e.xml"), metrics).collect()] == [("Steps", 1)]


def test_ledger(spark, tmp_path):
    entries = [{"id": "a", "kind": "travel", "start": "2024-01"}, {"id": "b", "kind": "illness", "start": "~2024-02-03", "supersedes": "a"}, {"id": "c", "kind": "odd", "start": "soon", "dose": {"value": "x", "unit": "mg"}}, {"id": "d", "kind": "travel", "supersedes": "zz"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, entries)))
    rows = measurements.read_ledger(spark, str(tmp_path / "l.json")).cache()
    got = {r.id: (r.start_earliest, r.start_latest, r.start_precision, r.violations) for r in rows.collect()}
    day = datetime.date
    assert got == {"a": (day(2024, 1, 1), day(2024, 1, 31), "month", []), "b": (day(2024, 2, 3), day(2024, 2, 3), "approximate", []), "c": (None, None, None, ["kind", "dose", "start"]), "d": (None, None, "unknown", [])}
    stored = rows.where("id = 'a'").select("id", "entry_hash")
    assert sorted(map(tuple, measurements.append_plan(rows, stored).collect())) == [("a", "skip"), ("b", "append"), ("c", "invalid"), ("d", "no_target")]


def test_items(spark, tmp_path):
    pages = {"bookmarks": [{"id": "1", "createdAt": "2024-01-01T00:00:00Z", "tags": [{"name": "t"}], "content": {"type": "link", "url": "https://a.com", "title": "A"}}, {"id": "2", "createdAt": "2024-01-02T00:00:00Z", "modifiedAt": "2024-01-03T00:00:00Z", "title": "", "content": {"type": "text", "text": "x" * 300}}]}
    for name in ("1", "2"):
        (tmp_path / f"b{name}.json").write_text(json.dumps(pages))
    got = {r.external_id: (len(r.title), r.url, r.tags, str(r.updated_at)) for r in items.read_bookmarks(spark, str(tmp_path / "b*.json")).collect()}
    assert got == {"1": (1, "https://a.com", ["t"], "2024-01-01 00:00:00"), "2": (200, None, [], "2024-01-03 00:00:00")}
    works = [{"key": "k", "data": {"itemType": "book", "title": "T", "DOI": "10.1/x", "creators": [{"firstName": "A", "lastName": "B"}, {"name": "C"}]}}, {"key": "n", "data": {"itemType": "note"}}]
    (tmp_path / "w.json").write_text(json.dumps(works))
    (row,) = items.read_works(spark, str(tmp_path / "w.json")).collect()
    assert (row.external_id, row.doi, json.loads(row.meta)["creators"]) == ("k", "10.1/x", ["A B", "C"])
    for place in ("brain/10 Themes/a b.md", "brain/other/c.md", "brain/10 Themes/.hid/d.md"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text("note")
    assert [(r.external_id, r.title, r.text) for r in items.read_notes(spark, str(tmp_path / "brain"), ["10 Themes"]).collect()] == [("10 Themes/a b.md", "a b", "note")]


def test_social(spark, tmp_path):
    tweets = [{"tweet": {"id_str": "1", "full_text": "hi\nall", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "entities": {"urls": [{"expanded_url": "https://a.com"}]}}}, {"tweet": {"id_str": "2", "full_text": " "}}, {"tweet": {"id_str": "3", "full_text": "re", "in_reply_to_status_id_str": "9"}}]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "tweets.js").write_text("window.YTD.tweets.part0 = " + json.dumps(tweets))
    (tmp_path / "x" / "like-part1.js").write_text("window.YTD.like.part1 = " + json.dumps([{"like": {"tweetId": "5"}}]))
    (tmp_path / "x" / "tweet-headers.js").write_text("window.x = [{}]")
    got = {r.external_id: (r.kind, r.title, r.url, str(r.created_at), json.loads(r.meta)["post_type"]) for r in items.read_wrapped_posts(spark, str(tmp_path / "x")).collect()}
    assert got == {"x:1": ("social_post", "hi", "https://a.com", "2018-10-10 20:19:24", "post"), "x:3": ("social_post", "re", "https://x.com/i/status/3", "None", "reply"), "xlike:5": ("bookmark", "", "https://x.com/i/status/5", "None", "like")}
    posts = [{"timestamp": 1, "data": [{"post": "Ã©tÃ©"}, {"post": "two"}]}, {"timestamp": 2, "data": []}]
    said = {"comments_v2": [{"timestamp": 3, "title": "t", "data": [{"comment": {"comment": "ok", "author": "me"}}, {"comment": {"comment": " ", "author": "me"}}]}]}
    (tmp_path / "p.json").write_text(json.dumps(posts))
    (tmp_path / "c.json").write_text(json.dumps(said))
    found, authors = items.read_own_posts(spark, str(tmp_path / "p.json"), str(tmp_path / "c.json"))
    assert sorted((r.text, str(r.created_at)) for r in found.collect()) == [("ok", "1970-01-01 00:00:03"), ("été\ntwo", "1970-01-01 00:00:01")]
    assert authors.first()[0] == 1
