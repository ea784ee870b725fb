"""The ledger of every signup, and the operators that stand on it, against plain loops."""

import collections
import datetime

import __spark_entry__ as entry
from mnemospark.operators import observations

DATA = "/root/testdata/sf0.001"


def test_every_signup_is_in_the_ledger(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").collect()
    signups = {e.event_id for e in events if e.event_type == "signup"}
    named = {name: {r.event_id for r in entry.queries()[name](spark, DATA).collect()} for name in ("j5_active_days_whole", "j4_chain_heads_whole", "a8_event_response_whole")}
    assert named["j5_active_days_whole"] == signups
    last, gone = {}, set()
    for e in sorted((e for e in events if e.event_type == "signup"), key=lambda e: (e.user_id, e.ts, e.event_id)):
        if e.event_id % 5 == 0 and e.user_id in last:
            gone.add(last[e.user_id])
        last[e.user_id] = e.event_id
    assert gone and named["j4_chain_heads_whole"] == signups - gone == named["a8_event_response_whole"]


def test_overlay_and_response(spark):
    day = lambda n: datetime.date(2024, 1, 28) + datetime.timedelta(n)
    seen = [("m", day(n), v) for n, v in ((0, 1.0), (0, None), (2, 2.0), (3, 4.0), (9, None))] + [("n", day(2), 8.0)]
    events = [(1, day(-5), day(-4), None, None), (2, day(2), day(2), day(2), None), (3, day(2), day(2), day(40), 1), (4, None, None, None, None), (5, day(5), day(5), day(4), None), (6, day(20), day(21), None, None)]
    obs = spark.createDataFrame(seen, "metric string, observed date, value double")
    ledger = spark.createDataFrame(events, "event_id long, start_earliest date, start_latest date, end_latest date, supersedes long")
    days = {d: {i for i, a, _, b, _ in events if a and a <= d and (b is None or d <= b)} for _, d, _ in seen}
    assert sorted(tuple(r) for r in observations.active_days(obs, ledger).select("observed", "event_id").collect()) == sorted((d, i) for d, ids in days.items() for i in ids)
    counts = observations.overlay(obs, ledger)
    assert "active" not in counts.columns
    assert collections.Counter((r.metric, r.observed, r.value, r.n_active) for r in counts.collect()) == collections.Counter((m, d, v, len(days[d])) for m, d, v in seen)
    got = {(r.event_id, r.metric): (r.n_before, r.min_before, r.mean_before, r.n_after, r.max_after, r.mean_after, r.n_inside, r.n_non_numeric) for r in observations.event_response(obs, ledger, 2).collect()}
    one, two = (1, 1.0, 1.0, 1, 4.0, 4.0, 1, 1), (0, None, None, 0, None, None, 1, 0)
    five = (1, 4.0, 4.0, 0, None, None, 0, 0)
    assert got == {(2, "m"): one, (3, "m"): one, (2, "n"): two, (3, "n"): two, (5, "m"): five}
