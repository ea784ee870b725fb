"""Tables of facts that reports consist of: event points, coverage, status, timeline, histories, the closed week."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators import observations


def event_points(obs: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """event_id, metric, side, n, points of every event: its days with numbers, and how many numbers each has.

    Days are summed up first and events by their dates, as in event_response(), so a window holds as many points as days.
    """
    spans = events.select("start_earliest", "start_latest").distinct().withColumn("event_id", F.struct("start_earliest", "start_latest"))
    daily = obs.groupBy("metric", "observed").agg(F.count("value").alias("n")).where("n > 0")
    found = observations.in_window(daily, spans, days).groupBy("event_id", "metric", "side").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("observed", "n"))).alias("points"))
    found = found.select("event_id.*", "metric", "side", "n", "points")
    return events.select("event_id", "start_earliest", "start_latest").join(found, ["start_earliest", "start_latest"]).drop("start_earliest", "start_latest")


def reasons(rows: DataFrame, reason: Column) -> DataFrame:
    """How many rows were set aside, by reason."""
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def coverage(obs: DataFrame) -> DataFrame:
    """Per metric and over all (metric null): rows, rows without a number, distinct dates."""
    return obs.rollup("metric").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_provisional"), F.count_distinct("observed").alias("n_dates"))


def status(obs: DataFrame, events: DataFrame, today: str) -> DataFrame:
    """part, key, day: the latest row of each metric, and events that are active today or whose start is uncertain."""
    latest = observations.newest(obs, "metric", [F.desc("observed"), F.desc("event_id")], 1).select(F.lit("latest").alias("part"), F.col("metric").alias("key"), F.col("observed").alias("day"))
    day, heads = F.lit(today).cast("date"), observations.chain_heads(events)
    active = heads.where((F.col("start_earliest") <= day) & (F.col("end_latest").isNull() | (F.col("end_latest") >= day)))
    unsure = heads.where("start_earliest IS NULL OR start_earliest < start_latest")
    rows = lambda part, x: x.select(F.lit(part).alias("part"), F.col("event_id").cast("string").alias("key"), F.col("start_earliest").alias("day"))
    return latest.unionAll(rows("active", active)).unionAll(rows("uncertain", unsure))


def timeline(obs: DataFrame, events: DataFrame, dates: int, months: int) -> DataFrame:
    """part, key, period, n: events, rows on the newest dates, and newest months of each metric."""
    own = events.select(F.lit("event").alias("part"), F.col("event_id").cast("string").alias("key"), F.col("start_earliest").cast("string").alias("period"), F.lit(1).cast("long").alias("n"))
    rows = observations.newest_dates(obs, dates).groupBy("metric", "observed").agg(F.count("*").alias("n")).select(F.lit("day"), "metric", F.col("observed").cast("string"), "n")
    monthly = observations.newest(observations.summary(obs, observations.MONTH), "metric", [F.desc("period")], months).select(F.lit("month"), "metric", "period", "n")
    return own.unionAll(rows).unionAll(monthly)


def histories(obs: DataFrame, n: int) -> DataFrame:
    """The newest rows of each series; metric and source with one measurement alone are told apart from series."""
    size = F.count("*").over(Window.partitionBy("metric", "source"))
    kinds = obs.withColumn("kind", F.when(size == 1, "single").otherwise("series"))
    place = F.row_number().over(Window.partitionBy("kind", "metric", "source").orderBy(F.desc("observed"), F.desc("event_id")))
    return kinds.withColumn("place", place).where(F.col("place") <= n)


def closed_week(now: datetime.datetime, week: str | None = None) -> tuple[str, datetime.date, datetime.date]:
    """Name, Monday and Sunday of the week asked for, or else of the last one that closed: weeks close Sundays at 18."""
    if week:
        year, number = week.split("-W")
        monday = datetime.date.fromisocalendar(int(year), int(number), 1)
    else:
        monday = now.date() - datetime.timedelta(days=now.weekday())
        if not (now.weekday() == 6 and now.hour >= 18):
            monday -= datetime.timedelta(days=7)
    return "{}-W{:02d}".format(*monday.isocalendar()[:2]), monday, monday + datetime.timedelta(days=6)


def week_facts(rows: DataFrame, monday: datetime.date, section: str, day: str) -> DataFrame:
    """section, n, first, last of the rows of a week."""
    own = rows.where(F.col(day).between(F.lit(monday), F.date_add(F.lit(monday), 6)))
    return own.groupBy(section).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def broken_references(rows: DataFrame, listed: DataFrame, path: str) -> DataFrame:
    """path, n of paths that rows name but no listing has."""
    return rows.where(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("n")).join(listed.select(path).distinct(), path, "left_anti")


def ungrounded(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Claims whose ids are not all in their segment. claims: claim_id, segment_id, ids; segments: segment_id, ids."""
    own = claims.join(segments.select("segment_id", F.col("ids").alias("_own")), "segment_id", "left")
    return own.where(F.size(F.array_except("ids", F.coalesce("_own", F.array().cast(segments.schema["ids"].dataType)))) > 0).select("claim_id", "segment_id")


def unfounded(evidence: DataFrame, tables: dict[str, DataFrame], roles: list[str]) -> DataFrame:
    """Evidence of an unknown kind or role, or whose id its kind's table does not have. tables: kind to a table of id."""
    known = None
    for kind, table in tables.items():
        one = table.select(F.lit(kind).alias("kind"), F.col("id"))
        known = one if known is None else known.unionAll(one)
    rows = evidence.join(known.distinct().withColumn("_there", F.lit(True)), ["kind", "id"], "left")
    fault = F.when(~F.col("kind").isin(list(tables)), "kind").when(~F.col("role").isin(roles), "role").when(F.col("_there").isNull(), "missing")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").drop("_there")
