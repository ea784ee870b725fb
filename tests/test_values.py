"""Times, durations, vectors and detectors by hand-made cases."""

from pyspark.sql import functions as F

from mnemospark.functions import entities, values
from mnemospark.operators import items
from mnemospark.session import ship
from mnemospark.sources import items as sources


def test_instants(spark):
    said = {
        "2024-01-02T03:04:05Z": 1704164645, "2024-01-02T03:04:05+09:00": 1704132245, "2024-01-02 03:04:05": 1704164645, "2024-01-02": 1704153600, "2024-01-02 03:04:05 +0900": 1704132245,
        "Tue Jan 02 03:04:05 +0000 2024": 1704164645, "Tue, 2 Jan 2024 03:04:05 +0000": 1704164645, "1704164645": 1704164645, "1704164645.5": 1704164645, "2024": None, "soon": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", F.unix_seconds(values.instant(F.col("s"))).alias("at")).collect()
    assert {r.s: r["at"] for r in rows} == said


def test_minutes(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:01:30.5' AS b, CAST(NULL AS timestamp) AS c")
    assert row.select(values.minutes_between("a", "b"), values.minutes_between("b", "a"), values.minutes_between("a", "c")).first() == (1.508, -1.508, None)


def test_vectors(spark):
    ship(spark)
    rows = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    assert [r.v for r in rows.select(values.unpacked(values.packed("v")).alias("v")).collect()] == [[1.0, -2.5], [], None]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(values.unpacked("b")).first()[0] is None
    near = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] and round(r[0], 6) for r in near.select(values.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, None]


def test_first_rows_and_authors(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, ""), ("b", 3, None)], "k string, n int, author string")
    assert sorted((r.k, r.n) for r in items.first_of(rows, ["k"], "n").collect()) == [("a", 1), ("b", 3)]
    assert sources.distinct_authors(rows).first()[0] == 2
    assert {r.k: r.comment_authors for r in sources.distinct_authors(rows, "k").collect()} == {"a": 2}


def test_own_detectors(spark):
    tags = lambda text: F.transform(F.regexp_extract_all(text, F.lit("#([a-z]+)"), F.lit(1)), lambda t: entities._entity("tag", t, t, F.concat(F.lit("#"), t), F.lit(0)))
    rows = spark.createDataFrame([(1, "#one https://x.org/a #two"), (2, None)], "unit_id int, text string")
    assert sorted((r.kind, r.canonical_name) for r in entities.mentions(rows, (*entities.DETECTORS, tags)).collect()) == [("tag", "one"), ("tag", "two"), ("url", "https://x.org/a")]


def test_places_count_characters(spark):
    text = "🎉🎉 https://x.org/a, and 日本 github.com/A/B. https://x.org/b)"
    for r in entities.mentions(spark.createDataFrame([(1, text)], "unit_id int, text string")).collect():
        assert text[r.start_offset : r.end_offset] == r.surface
