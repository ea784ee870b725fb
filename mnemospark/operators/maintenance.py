"""What keeps an archive current: work left to do, files that changed, rows made anew, runs and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(units: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Units for which nothing was derived yet. Keys may hold a version, so that a new one makes all pending."""
    return units.join(done.select(*keys), [*keys], "left_anti")


def regenerated(stored: DataFrame, fresh: DataFrame, key: str, locked: Column) -> DataFrame:
    """Stored rows that a user locked, and fresh rows of all other keys."""
    kept = stored.where(locked)
    return kept.unionByName(fresh.select(*stored.columns).join(kept.select(key), key, "left_anti").select(*stored.columns))


def new_rows(found: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Found rows, once for each key, whose key is not stored."""
    return found.dropDuplicates([*keys]).join(stored.select(*keys), [*keys], "left_anti")


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose size or time is not the one of the last scan. Both: path, size, modified."""
    return listing.join(state.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def forgotten(state: DataFrame, prefix: str) -> DataFrame:
    """State without the files below a prefix, which are then read again."""
    return state.where(~F.col("path").startswith(prefix))


def relinked(derived: DataFrame, turns: DataFrame) -> DataFrame:
    """Derived rows (conv_id, start_turn, end_turn) whose ends are still in their thread."""
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("_a"), F.max("turn").alias("_b"))
    return derived.join(ends, "conv_id").where("start_turn >= _a AND end_turn <= _b AND start_turn <= end_turn").select(*derived.columns)


def run_counts(actions: DataFrame, by: str) -> DataFrame:
    """Inserted, updated, skipped rows of an import, by input."""
    count = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy(by).agg(count("insert").alias("inserted"), count("update").alias("updated"), count("skip").alias("skipped"), F.count("*").alias("seen"))


def import_runs(actions: DataFrame, warnings: DataFrame, by: str, most: int = 2_000) -> DataFrame:
    """run_counts() with the first warnings of each input, a line each, up to so many characters.

    warnings: the input, place, warning. Those beyond the limit are left out before lines are gathered.
    """
    before = F.sum(F.length("warning") + 1).over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    first = warnings.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most)
    lines = first.groupBy(by).agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "warning"))), lambda x: x["warning"]), "\n"), F.lit(most)).alias("warnings"))
    return run_counts(actions, by).join(lines, by, "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def latest_states(runs: DataFrame, run: str, time: str) -> DataFrame:
    """The last state of each run, of a table to which states are only added."""
    rest = [c for c in runs.columns if c != run]
    return runs.groupBy(run).agg(F.max_by(F.struct(*rest), F.col(time)).alias("r")).select(run, "r.*")


def stale(sources: DataFrame, seen: DataFrame, source: str, time: str, now: Column, days: int) -> DataFrame:
    """Sources whose newest row is more than ``days`` old, or that have none."""
    last = seen.groupBy(source).agg(F.max(time).cast("date").alias("last_seen"))
    aged = sources.select(source).distinct().join(last, source, "left").withColumn("age", F.datediff(now, "last_seen"))
    return aged.where(F.col("age").isNull() | (F.col("age") > days))


def dominant(rows: DataFrame, *keys: str) -> DataFrame:
    """The most frequent combination; of several the first in order."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    every = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        every = one if every is None else every.unionAll(one)
    return every
