"""Live feeds of measurements: fingerprints kept once, daily summaries as rows arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark.session import scratch


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that land under a path. Files are read once, so they must not grow in place."""
    return spark.readStream.schema(schema).parquet(path)


def once(feed: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys were not seen before, as long as repeats come no later than ``late`` after each other."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def lasting(spark: SparkSession) -> None:
    """State that must outlive memory is kept in RocksDB: for first_ever() and corrections()."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_ever(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were never seen before, however long ago: the same file a year later adds nothing.

    Without a watermark no key is forgotten, so state grows with the number of keys, on disk, dealt over partitions.
    """
    lasting(feed.sparkSession)
    return feed.dropDuplicates(keys)


class _Superseded(StatefulProcessor):
    """For one id: its own row, and whether another has superseded it; either may come first, and may come again."""

    def __init__(self, columns: list[str], schema: str):
        self.columns, self.schema = columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", self.schema)
        self.gone = handle.getValueState("gone", "gone boolean")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.is_own and not self.own.exists():
                    own = tuple(None if pd.isna(v) else v for v in (getattr(row, c) for c in self.columns))
                    self.own.update(own)
                    if not self.gone.exists():
                        out.append((key[0], 1, *own))
                elif not row.is_own and not self.gone.exists():
                    self.gone.update((True,))
                    if self.own.exists():
                        out.append((key[0], -1, *self.own.get()))
        if out:
            yield pd.DataFrame(out, columns=["id", "sign", *self.columns])

    def close(self) -> None:
        pass


def corrections(feed: DataFrame, columns: list[str]) -> DataFrame:
    """id, sign and the columns: +1 for a row that counts from now on, -1 for one that a later row supersedes.

    feed: id, supersedes (null, or the id of the row it stands for) and the columns. Sums of column times sign follow
    late corrections, also those that come before what they correct; rows that come again add nothing.
    """
    lasting(feed.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in feed.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    sent = F.array(F.struct(F.col("id").alias("key"), F.lit(True).alias("is_own")), F.struct(F.col("supersedes").alias("key"), F.lit(False).alias("is_own")))
    rows = feed.select(F.explode(sent).alias("m"), *columns).select("m.*", *columns).where("key IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(_Superseded(columns, schema), f"id {kinds['id']}, sign int, {schema}", "Append", "none")


def standing(feed: DataFrame, columns: list[str]) -> DataFrame:
    """id, gone, come and the columns, in update mode: of each id that a batch bears on, whether another has superseded it by now.

    feed as for corrections(). An id's last state says whether and with what it counts (come: its own row was
    there); rows that come again change nothing. State is a native aggregate by id, without Python, for ids by the million.
    """
    lasting(feed.sparkSession)
    own = F.struct(F.col("id").alias("key"), F.struct(*columns).alias("own"), F.lit(False).alias("gone"))
    other = F.struct(F.col("supersedes").alias("key"), F.lit(None).cast(_struct(feed, columns)).alias("own"), F.lit(True).alias("gone"))
    rows = feed.select(F.explode(F.array(own, other)).alias("m")).select("m.*").where("key IS NOT NULL")
    state = rows.groupBy(F.col("key").alias("id")).agg(F.first("own", ignorenulls=True).alias("own"), F.max("gone").alias("gone"))
    return state.select("id", "gone", F.col("own").isNotNull().alias("come"), "own.*")


def _struct(feed: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in feed.schema}
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in columns) + ">"


def daily(feed: DataFrame, key: str, time: str, value: str, late: str = "2 days") -> DataFrame:
    """Rows, smallest and largest value by key and day. State of a day goes when the watermark has passed it."""
    days = feed.withWatermark(time, late).groupBy(key, F.window(time, "1 day").alias("w"))
    found = days.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(key, F.col("w.start").cast("date").alias("day"), "n", "low", "high")


def drain(feed: DataFrame, name: str, mode: str, keys: list[str]) -> DataFrame:
    """Runs a stream over all that has landed into a table in the shared folder; of each key the last state counts.

    Batches are written under their number, so one that runs again replaces itself.
    """
    spark = feed.sparkSession
    base = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    feed.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(feed.select("*", F.lit(0).alias("_batch")).schema).parquet(f"{base}/rows")
    if not keys:
        return rows.select(*feed.columns)
    rest = [c for c in feed.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*keys, "r.*").select(*feed.columns)
