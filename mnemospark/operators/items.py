"""Items and their threads: enrichment, one listing of all, what is stored anew, cascades, hashes on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import keys, text


def enriched(hits: DataFrame, threads: DataFrame, registry: DataFrame) -> DataFrame:
    """Hits (conv_id, ...) with their thread's columns, and the registry's where the thread is an item."""
    return hits.join(threads, "conv_id").join(registry, "conv_id", "left")


def pool(chunks: DataFrame, items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks of the given items that have a vector: what a semantic search chooses from. All by their ids."""
    return chunks.join(items, "item_id").join(vectors, "chunk_id")


def all_items(threads: DataFrame, items: DataFrame) -> DataFrame:
    """Threads and other items in one list: item_key, kind, source, title, updated_at, message_count."""
    own = threads.select(F.concat(F.lit("thread:"), F.col("conv_id").cast("string")).alias("item_key"), F.lit("conversation").alias("kind"), "source", "title", "updated_at", "message_count")
    other = items.select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("item_key"), "kind", "source", "title", "updated_at")
    return own.unionByName(other, allowMissingColumns=True)


def pruned(stored: DataFrame, listed: DataFrame, complete: bool, chunks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items that are still listed, with their chunks, and links of which both ends are left.

    Nothing goes where the listing is empty or not a complete one.
    """
    if not complete or listed.isEmpty():
        return stored, chunks, links
    kept = stored.join(listed.select("item_id").distinct(), "item_id", "left_semi")
    left = kept.select("item_id")
    both = links.join(left.withColumnRenamed("item_id", "a"), "a", "left_semi").join(left.withColumnRenamed("item_id", "b"), "b", "left_semi")
    return kept, chunks.join(left, "item_id", "left_semi"), both


def unmatched(stored: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """side, key: stored hashes that are nowhere, and present ones that nothing stores."""
    a, b = stored.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionAll(b.join(a, key, "left_anti").select(F.lit("orphan"), key))


def canonical(*columns: Column | str) -> Column:
    """A hash of columns by value: nulls, empty texts and separators inside values stay apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def thread_hash(messages: DataFrame) -> DataFrame:
    """conv_id, content_hash over role and text of all messages in order."""
    own = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.sha2(F.to_json(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))), 256).alias("content_hash"))


def plan(incoming: DataFrame, stored: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    """key, action: insert, update or skip for each incoming row by its content hash; of rows of one key the first hash counts."""
    new = incoming.groupBy(key).agg(F.min(digest).alias("_new"))
    old = stored.select(key, F.col(digest).alias("_old"))
    return new.join(old, key, "left").select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("_new"), "skip").otherwise("update").alias("action"))


def upserted(incoming: DataFrame, stored: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """The table after an import: stored rows that nothing replaces, and incoming ones that are new or changed."""
    wanted = actions.where("action <> 'skip'").select(key)
    return stored.join(wanted, key, "left_anti").unionByName(incoming.join(wanted, key, "left_semi").select(*stored.columns))


def with_derived(items: DataFrame) -> DataFrame:
    """Items as they are stored: text and title without secrets, the normal URL and the DOI, and a hash without times."""
    own = items.withColumn("title", text.redact_title(F.col("title"))).withColumn("text", text.redact(F.col("text")))
    own = own.withColumn("url_norm", keys.normal_url(F.col("url"))).withColumn("doi", keys.doi(F.col("url")))
    return own.withColumn("content_hash", canonical("kind", "title", "url", "text"))


def registry(threads: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each thread and item: source, external_id, kind. A view, so it can't drift from what it shows."""
    return threads.select("source", F.col("conv_id").cast("string").alias("external_id"), F.lit("conversation").alias("kind")).unionAll(items.select("source", F.col("item_id").cast("string"), "kind"))


def index_text(title: Column, fields: list[Column], lists: list[Column]) -> Column:
    """What of an item is searched: title, texts, then joined lists, each that is not blank on lines of its own."""
    joined = [F.array_join(F.filter(x, lambda v: F.trim(v) != ""), ", ") for x in lists]
    return F.array_join(F.filter(F.array(title, *fields, *joined), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), "\n")


def unchunked(units: DataFrame, chunks: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Units without chunks of this version, or all."""
    return units if force else units.join(chunks.where(F.col("version") == version).select("unit_id"), "unit_id", "left_anti")


def rewritten(messages: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a column holds a secret, with the columns redacted; all other rows need not be written again."""
    found = messages
    for c in columns:
        found = found.withColumn(f"_{c}", text.redact(F.col(c)))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = found.where(changed)
    return found.select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in messages.columns))


def lifecycle(notes: DataFrame, evidence: DataFrame) -> DataFrame:
    """note_id, state, n_evidence, acceptable of notes: superseded where another note says so; acceptable with evidence.

    notes: note_id, state, supersedes; evidence: note_id.
    """
    gone = notes.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("note_id")).distinct().withColumn("_gone", F.lit(True))
    count = evidence.groupBy("note_id").agg(F.count("*").alias("n_evidence"))
    rows = notes.join(gone, "note_id", "left").join(count, "note_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    return rows.select("note_id", F.when(F.col("_gone"), "superseded").otherwise(F.col("state")).alias("state"), "n_evidence", (F.col("_gone").isNull() & (F.col("n_evidence") > 0)).alias("acceptable"))


def swept(cursor: DataFrame, page: DataFrame, time: str) -> DataFrame:
    """Rows of a source's page at or after its cursor; those at the cursor come again, since others may share its time."""
    return page.join(cursor, "source", "left").where(F.col("cursor").isNull() | (F.col(time) >= F.col("cursor"))).drop("cursor")


def next_cursor(cursor: DataFrame, taken: DataFrame, time: str, ok: Column) -> DataFrame:
    """The newest time taken of each source; a source of which a row failed keeps its cursor."""
    new = taken.groupBy("source").agg(F.max(time).alias("_new"), F.bool_and(ok).alias("_ok"))
    return cursor.join(new, "source", "full").select("source", F.when(F.coalesce("_ok", F.lit(False)), F.greatest("cursor", "_new")).otherwise(F.col("cursor")).alias("cursor"))


def due(sources: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Sources whose last complete sweep is so long ago, or that had none. sources: source, swept_at."""
    return sources.where(F.col("swept_at").isNull() | (F.col("swept_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))))


def touched(files: DataFrame, known: DataFrame, last_scan: str, margin_hours: int = 1) -> DataFrame:
    """Files that are unknown, or changed since an hour before the last scan. files: path, modified; known: path."""
    old = known.select("path").distinct().withColumn("_known", F.lit(True))
    since = F.lit(last_scan).cast("timestamp") - F.make_dt_interval(hours=F.lit(margin_hours))
    return files.join(old, "path", "left").where(F.col("_known").isNull() | (F.col("modified") >= since)).drop("_known")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the first."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
