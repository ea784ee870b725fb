"""The archive's relational core: threads, listings, paging, exports, links between items, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups of more items than this share a key that says nothing; they are dropped before the self join.
MOST_LINKED = 30


def thread_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("user_count"))


def recency_page(threads: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return threads.orderBy(F.desc_nulls_last("updated_at"), "conv_id").offset(offset).limit(limit)


def budget_page(messages: DataFrame, budget: int) -> DataFrame:
    """Messages of each thread until a character budget is spent, at least one."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("spent", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where((F.col("spent") == 0) | (F.col("spent") + F.length("text") <= budget))


def threads_as_json(messages: DataFrame) -> DataFrame:
    """One JSON document for each thread, its messages in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(turns.alias("messages")).select("conv_id", F.to_json(F.struct(F.lit("thread/1").alias("schema"), "conv_id", "messages")).alias("json"))


def threads_as_markdown(messages: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(turns.alias("m")).select("conv_id", F.array_join(F.transform("m", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"])), "\n\n---\n\n").alias("markdown"))


def in_segments(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Messages between each segment's first and last position."""
    return messages.join(segments, "conv_id").where("turn BETWEEN start_turn AND end_turn")


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def changes(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """insert, update or skip for each incoming row, by a hash of its content."""
    # As JSON, so that nulls, empty texts and separators inside values stay apart.
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    old = stored.select(key, digest.alias("old_hash"))
    new = incoming.select(key, digest.alias("new_hash"))
    return new.join(old, key, "left").select(key, F.when(F.col("old_hash").isNull(), "insert").when(F.col("old_hash") == F.col("new_hash"), "skip").otherwise("update").alias("action"))


def upsert(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The stored rows with those of the same key replaced, and new ones added."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming.select(*stored.columns))


def prune(stored: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Stored rows that are still listed."""
    return stored.join(listed.select(key).distinct(), key, "left_semi")


def linked_pairs(keys: DataFrame, most: int = MOST_LINKED) -> DataFrame:
    """Pairs of items that share a key. keys: item, via, key. Group sizes are bounded before the self join."""
    return linked_pairs_by_key(keys, most).select("a", "b", "via").distinct()


def linked_pairs_by_key(keys: DataFrame, most: int = MOST_LINKED) -> DataFrame:
    """a, b, via, key: a pair for each key that both have."""
    keys = keys.where("key IS NOT NULL").distinct()
    sizes = keys.groupBy("via", "key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("via", "key")
    own = keys.join(sizes, ["via", "key"], "left_semi")
    other = own.select("via", "key", F.col("item").alias("b"))
    return own.join(other, ["via", "key"]).where("item < b").select(F.col("item").alias("a"), "b", "via", "key")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Items one link away from each seed, with what links them."""
    both = edges.select(F.col("a").alias("item"), F.col("b").alias("neighbour"), "via").unionAll(edges.select("b", "a", "via"))
    return both.join(seeds.select("item").distinct(), "item", "left_semi")
