"""Keys and cleaned values on single cases."""

import datetime

from pyspark.sql import functions as F

from mnemospark.functions import keys as K


def _of(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_urls(spark):
    given = {
        "HTTPS://www.Example.com:443/a/?utm_source=x&b=2&a=1#f": "https://example.com/a?a=1&b=2",
        "https://user@mobile.twitter.com/i/1?s=20&q=1": "https://x.com/i/1?q=1",
        "http://a.com:8080/": "http://a.com:8080",
        "https://youtu.be/abc?t=3": "https://youtube.com/watch?v=abc",
        "https://arxiv.org/pdf/2401.00001v2.pdf": "https://arxiv.org/abs/2401.00001",
        "http://localhost:$PORT/x": None, "ftp://a.com": None, "": None, None: None, "https://a.com/?x=": "https://a.com?x=",
    }
    assert _of(spark, K.normal_url, list(given)) == list(given.values())
    given = {"https://github.com/Own/Repo.git/tree/main": "github.com/own/repo", "https://github.com/topics/x": None, "https://github.com/own": None, "https://a.com/b/c": None}
    assert _of(spark, K.repository, list(given)) == list(given.values())
    given = {"10.1/AbC/": "10.1/abc", "doi: 10.2/x": "10.2/x", "https://dx.doi.org/10.3%2Fy": "10.3/y", "11.1/x": None, "10.5": None, None: None}
    assert _of(spark, K.doi, list(given)) == list(given.values())


def test_values(spark):
    given = {"Ã©tÃ©": "été", "été": "été", "日本": "日本", "plain": "plain", None: None}
    assert _of(spark, K.repaired, list(given)) == list(given.values())
    day = datetime.date
    assert _of(spark, K.any_date, ["2024-01-05", "2024/1/5", "1/5/2024", "1/5/24", "x", None]) == [day(2024, 1, 5)] * 4 + [None] * 2
    got = [tuple(x) for x in _of(spark, K.when, ["2024-02-03", "~2024-02", "2024-02", None, "soon"])]
    assert got == [("2024-02-03", day(2024, 2, 3), day(2024, 2, 3), "date"), ("~2024-02", day(2024, 2, 1), day(2024, 2, 29), "approximate"), ("2024-02", day(2024, 2, 1), day(2024, 2, 29), "month"), (None, None, None, "unknown"), ("soon", None, None, None)]
    assert _of(spark, K.number, ["1,234.5", "<5", None]) == [1234.5, None, None]
    assert [len(x) for x in _of(spark, K.unsafe_phrases, ["You  should\nstop now", "服用を\n中止してください", "fine"])] == [1, 1, 0]
    assert _of(spark, K.title_of, [" a\nb", "x" * 61]) == ["a", "x" * 60 + "…"]
