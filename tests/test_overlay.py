"""Overlays of instants between milliseconds, against DuckDB."""

import datetime

import duckdb

from mnemospark.plans import queries


def test_instants_between_milliseconds(spark, tmp_path):
    micros = [*range(0, 3000, 100), 1_999_499, 1_999_500, 2_000_499, 2_000_500, -499, -500, -1500]
    start = datetime.datetime(1970, 1, 1)
    rows = [(i % 7 and i * 1_000_000 // 37 + i, start + datetime.timedelta(microseconds=m), ("signup", "click")[i % 2]) for i, m in enumerate(micros)]
    rows += [(1_000_000 + i, start + datetime.timedelta(seconds=i, microseconds=m), "signup") for i, m in enumerate(micros)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found, sql = queries.REGISTERED["j5_overlay_instants"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r.event_id, r.ts, r.n_active) for r in found(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT event_id, ts, n_active FROM ({sql})").fetchall())
