"""Filters and listings of items: by source, kind, date, tag, folder; periods; point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of items, and titles and beginnings of titles of threads that say nothing.
KINDS = ["bookmark", "conversation", "note", "reference", "social_post"]
NO_TITLES = ["New chat", "User Request: Help Needed", "Untitled"]
NO_TITLE_STARTS = ["Review this change for security vulnerabilities.", "You are a security expert reviewing"]
# Fewer messages are no thread worth a look; days of a period unless given, and at most.
LEAST_MESSAGES, PERIOD_DAYS, MOST_DAYS = 4, 366, 3650


def item_filter(items: DataFrame, sources: list[str] | None = None, kinds: list[str] | None = None, after: str | None = None, before: str | None = None, time: str | Column = "updated_at") -> DataFrame:
    """Items of some sources and kinds whose time lies in an inclusive range; a bare date as its end lasts all day.

    With a range, items without a time fall out. Unknown kinds are an error.
    """
    if unknown := set(kinds or []) - set(KINDS):
        raise ValueError(f"no such kind: {', '.join(sorted(unknown))}")
    at = F.col(time) if isinstance(time, str) else time
    found = items.where(F.col("source").isin(sources)) if sources else items
    found = found.where(F.col("kind").isin(kinds)) if kinds else found
    found = found.where(at >= F.lit(after).cast("timestamp")) if after else found
    if before:
        end = F.lit(before).cast("timestamp")
        found = found.where(at < end + F.expr("INTERVAL 1 DAY") if len(before) == 10 else at <= end)
    return found


def effective(items: DataFrame) -> Column:
    """When an item was last changed, or else made."""
    return F.coalesce("updated_at", "created_at")


def newest_items(items: DataFrame, limit: int, offset: int = 0, **chosen) -> DataFrame:
    """A page of items by effective time, newest first, undated ones last."""
    return item_filter(items, **chosen, time=effective(items)).orderBy(F.desc_nulls_last(effective(items)), "item_id").offset(offset).limit(limit)


def with_more(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of an ordered frame and one more, by which a caller sees that there are more."""
    return rows.limit(limit + 1)


def worth_a_look(threads: DataFrame, least: int = LEAST_MESSAGES) -> DataFrame:
    """Threads with a title that says something and enough messages. threads: title, message_count."""
    title = F.trim(F.coalesce("title", F.lit("")))
    noise = (title == "") | title.isin(NO_TITLES)
    for start in NO_TITLE_STARTS:
        noise = noise | title.startswith(start)
    return threads.where(~noise & (F.col("message_count") >= least))


def tagged(items: DataFrame, tag: str) -> DataFrame:
    return items.where(F.array_contains("tags", tag))


def in_folder(items: DataFrame, prefix: str) -> DataFrame:
    return items.where(F.col("folder").startswith(prefix))


def looked_back(rows: DataFrame, text: str, now: str, days: int) -> DataFrame:
    """Rows whose time, a text, lies in the last days before now; what is no time falls out."""
    end = F.lit(now).cast("timestamp")
    return rows.where(F.try_to_timestamp(F.col(text)).between(end - F.make_dt_interval(F.lit(days)), end))


def review_first(items: DataFrame, tag: str = "to-review") -> DataFrame:
    """Items with the tag first, then by time, newest first."""
    return items.orderBy(~F.array_contains("tags", tag), F.desc_nulls_last("created_at"), "item_id")


def allowed(rows: DataFrame, catalog: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the catalog's keys, and how many there are of each other key; of those nothing else is read."""
    kept = rows.join(catalog.select(key).distinct(), key, "left_semi")
    dropped = rows.select(key).join(catalog.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return kept, dropped


def bounded_period(obs: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Observations of a period; unless given, the PERIOD_DAYS up to the latest one. Longer than MOST_DAYS is an error."""
    last = obs.agg(F.max("observed").alias("_last"))  # one row
    end = F.coalesce(F.lit(until).cast("date"), "_last")
    start = F.coalesce(F.lit(since).cast("date"), F.date_sub(end, PERIOD_DAYS))
    if since:
        width = last.select(F.datediff(end, start).alias("d")).first()["d"]
        if width is not None and width > MOST_DAYS:
            raise ValueError(f"a period has at most {MOST_DAYS} days")
    return obs.crossJoin(F.broadcast(last)).where(F.col("observed").between(start, end)).drop("_last")


def listing(rows: DataFrame, order: str, key: str, limit: int, *without: str) -> DataFrame:
    """A page of rows without their bodies, by an order that puts nulls last."""
    return rows.drop(*without).orderBy(F.asc_nulls_last(order), key).limit(limit)


def threads_of(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked thread with its messages in order, nested. asked: conv_id."""
    own = messages.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
