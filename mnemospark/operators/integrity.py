"""Checks that report rows which break a rule, and the weekly view of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no parent has; rows without a key are orphans too."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphan_counts(relation: str, child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """relation, n_orphans, n_keys: how many rows of child have no parent, and under how many keys."""
    lost = orphans(child.select(key), parent, key, parent_key)
    return lost.agg(F.count("*").alias("n_orphans"), F.count_distinct(key).alias("n_keys")).select(F.lit(relation).alias("relation"), "n_orphans", "n_keys")


def observation_violations(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Per metric: rows without a value or a time, and rows beyond the first of their fingerprint."""
    alike = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("no_value"), F.count_if(F.col("observed").isNull()).alias("no_time"))
    return alike.groupBy("metric").agg(F.sum("n").alias("n_rows"), F.sum("no_value").alias("n_no_value"), F.sum("no_time").alias("n_no_time"), F.sum(F.col("n") - 1).alias("n_repeated"))


def turn_structure(messages: DataFrame) -> DataFrame:
    """Per thread: turns, places where the next turn isn't the following number, and blank texts."""
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    placed = messages.select("conv_id", "text", (F.col("turn") - before).alias("step"))
    return placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("step") != 1).alias("n_jumps"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_blank"))


def recent_by_section(rows: DataFrame, section: str, time: str, ties: str, now: Column, days: int, most: int) -> DataFrame:
    """The newest ``most`` rows of each section within ``days`` before ``now``, with their place.

    The limit on row_number is applied before the shuffle as well, so a large section costs no more than a small one.
    """
    place = F.row_number().over(Window.partitionBy(section).orderBy(F.desc(time), ties))
    return rows.where((F.col(time) > now - F.make_dt_interval(F.lit(days))) & (F.col(time) <= now)).withColumn("place", place).where(F.col("place") <= most)
