"""Observation analytics: summaries, latest values, event windows, overlays, quality. All metrics in one job.

An observation has ``metric, observed (date), value, source``; an event has ``event_id, label, start_earliest,
start_latest, end_latest, supersedes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, WEEK, MONTH = "day", "week", "month"


def iso_week(date) -> F.Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), date).cast("int"), F.weekofyear(date))


def rounded(value) -> F.Column:
    """Four places, halves up; written so that other engines round alike."""
    return F.floor(value * 10000 + 0.5).cast("double") / 10000


def summary(obs: DataFrame, period: str = DAY) -> DataFrame:
    """Per metric and period: numeric values, values left out, least, greatest, mean (4 places) and sum."""
    key = {DAY: F.col("observed").cast("string"), WEEK: iso_week(F.col("observed")), MONTH: F.date_format("observed", "yyyy-MM")}[period]
    return obs.groupBy("metric", key.alias("period")).agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_excluded"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        rounded(F.avg("value")).alias("mean_value"), rounded(F.sum("value")).alias("sum_value"),
    )


def newest(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def latest_with_ties(obs: DataFrame) -> DataFrame:
    """All rows on each metric's last day."""
    last = obs.groupBy("metric").agg(F.max("observed").alias("observed"))
    return obs.join(last, ["metric", "observed"])


def newest_dates(obs: DataFrame, n: int) -> DataFrame:
    """Rows on the n newest distinct dates; the ranking runs over the distinct dates alone."""
    dates = obs.select("observed").distinct().orderBy(F.desc("observed")).limit(n)
    return obs.join(dates, "observed", "left_semi")


def data_quality(obs: DataFrame) -> DataFrame:
    return obs.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_without"), F.countDistinct("source").alias("sources"), F.min("observed").alias("first_date"), F.max("observed").alias("last_date"))


def missing_pairs(obs: DataFrame) -> DataFrame:
    """Metric and date pairs without a value, of all metrics and all dates seen: two distinct lists, one anti join."""
    pairs = obs.select("metric").distinct().crossJoin(obs.select("observed").distinct())
    return pairs.join(obs.where("value IS NOT NULL").select("metric", "observed").distinct(), ["metric", "observed"], "left_anti")


def chain_heads(events: DataFrame) -> DataFrame:
    """Events that no other supersedes."""
    gone = events.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("event_id"))
    return events.join(gone, "event_id", "left_anti")


def in_window(obs: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Each observation within ``days`` of an event's start, with its side of it.

    A range join by equality: an event goes to each day of its window, so what is joined is what comes out.
    """
    low, high = F.date_sub("start_earliest", days), F.date_add("start_latest", days)
    dated = events.where(low <= high)  # both dates known
    spread = dated.select("event_id", "start_earliest", "start_latest", F.explode(F.sequence(low, high)).alias("observed"))
    side = F.when(F.col("observed") < F.col("start_earliest"), "before").when(F.col("observed") > F.col("start_latest"), "after").otherwise("inside")
    return obs.join(spread, "observed").withColumn("side", side)


def event_response(obs: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Before and after of every event and metric.

    Observations are summed up by metric and day first and events by their dates, so that the range join grows with
    the calendar; the response of each pair of dates then goes to all its events. Means are taken to nine places before
    they are rounded, so that halves go up in whatever order the values were added.
    """
    spans = events.select("start_earliest", "start_latest").distinct().withColumn("event_id", F.struct("start_earliest", "start_latest"))
    daily = obs.groupBy("metric", "observed").agg(F.count("value").alias("n"), F.min("value").alias("low_value"), F.max("value").alias("high_value"), F.sum("value").alias("total"), F.count("*").alias("rows"))
    cols = []
    for side in ("before", "after"):
        own = lambda c, side=side: F.when(F.col("side") == side, F.col(c))
        n = F.coalesce(F.sum(own("n")), F.lit(0))
        cols += [n.alias(f"n_{side}"), F.min(own("low_value")).alias(f"min_{side}"), F.max(own("high_value")).alias(f"max_{side}"), rounded(F.round(F.sum(own("total")) / F.nullif(n, F.lit(0)), 9)).alias(f"mean_{side}")]
    inside = F.coalesce(F.sum(F.when(F.col("side") == "inside", F.col("rows"))), F.lit(0))
    found = in_window(daily, spans, days).groupBy("event_id", "metric").agg(*cols, inside.alias("n_inside"), F.sum(F.col("rows") - F.col("n")).alias("n_non_numeric"))
    found = found.select("event_id.*", *(c for c in found.columns if c != "event_id"))
    return events.select("event_id", "start_earliest", "start_latest").join(found, ["start_earliest", "start_latest"]).drop("start_earliest", "start_latest")


def interval_pieces(rows: DataFrame, low: str, high: str, *columns: str) -> DataFrame:
    """The columns of each row with level and place of the dyadic intervals that its whole numbers low to high consist of.

    A piece of level l at place p covers 2**l numbers from p * 2**l on. Each level has two pieces of an interval at most,
    so an interval of n numbers is some 2 log n rows, however long it is. Nulls and empty intervals have none.
    """
    spread = rows.where(F.col(low) <= F.col(high)).select(*columns, F.col(low).alias("_a"), (F.col(high) + 1).alias("_b"), F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col(high) - F.col(low) + 2)).cast("int"))).alias("_l"))
    # The blocks of this level that lie inside, less the pairs that the next level has.
    found = spread.withColumn("_f", F.expr("-shiftright(-_a, _l)")).withColumn("_e", F.expr("shiftright(_b, _l)")).where("_f < _e")
    places = F.array_compact(F.array(F.when(F.pmod("_f", F.lit(2)) == 1, F.col("_f")), F.when(F.pmod("_e", F.lit(2)) == 1, F.col("_e") - 1)))
    return found.select(*columns, F.col("_l").alias("level"), F.explode(places).alias("place"))


def interval_prefixes(points: DataFrame, at: str, pieces: DataFrame) -> DataFrame:
    """Each distinct number of points with level and place of the dyadic intervals that hold it, of levels that pieces have."""
    levels = pieces.select("level").distinct()  # 64 rows at most
    return points.select(at).where(F.col(at).isNotNull()).distinct().join(F.broadcast(levels)).withColumn("place", F.expr(f"shiftright(`{at}`, level)"))


def _days(date: str) -> Column:
    return F.unix_date(date).cast("long")


def _spans(obs: DataFrame, events: DataFrame) -> DataFrame:
    """Events with their days as numbers; an open end lasts to the last day seen."""
    last = obs.agg(F.max("observed").alias("_last"))  # one row
    return events.crossJoin(F.broadcast(last)).withColumn("_from", _days("start_earliest")).withColumn("_to", _days(F.coalesce("end_latest", "_last")))


def active_days(obs: DataFrame, events: DataFrame) -> DataFrame:
    """observed, event_id: each day with an observation and each event active that day."""
    pieces = interval_pieces(_spans(obs, events), "_from", "_to", "event_id")
    days = interval_prefixes(obs.withColumn("_day", _days("observed")), "_day", pieces)
    return days.join(pieces, ["level", "place"]).select(F.date_from_unix_date(F.col("_day").cast("int")).alias("observed"), "event_id")


def overlay(obs: DataFrame, events: DataFrame) -> DataFrame:
    """Each observation with how many events are active that day; active_days() says which."""
    return _counted(obs.withColumn("_at", _days("observed")), interval_pieces(_spans(obs, events), "_from", "_to")).drop("_at")


def overlay_instants(obs: DataFrame, events: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each observation with how many events are active at its very millisecond. An event without an end lasts.

    Milliseconds are the nearest ones, halves away from 1970, as DuckDB's epoch_ms has them.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    millis = lambda c: F.call_function("div", micros(c) + F.signum(micros(c)).cast("long") * 500, F.lit(1000))
    last = obs.agg(F.max(millis(at)).alias("_last"))  # one row
    spans = events.crossJoin(F.broadcast(last)).select(millis(start).alias("_from"), F.coalesce(millis(end), "_last").alias("_to"))
    return _counted(obs.withColumn("_at", millis(at)), interval_pieces(spans, "_from", "_to")).drop("_at")


def _counted(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """Points (_at) with n_active. Pieces are counted by place before they meet points, so no place has many rows."""
    counts = pieces.groupBy("level", "place").agg(F.count("*").alias("n"))
    active = interval_prefixes(points, "_at", pieces).join(counts, ["level", "place"]).groupBy("_at").agg(F.sum("n").alias("n_active"))
    return points.join(active, "_at", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))


def overlaps(events: DataFrame, since: str, until: str) -> DataFrame:
    """Events that overlap a period; without an end they last, without a start they don't count."""
    return events.where((F.col("start_earliest") <= F.lit(until).cast("date")) & (F.col("end_latest").isNull() | (F.col("end_latest") >= F.lit(since).cast("date"))))


def fingerprints(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows once for each fingerprint over the identifying columns."""
    return rows.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["fingerprint"])
