"""Files as they are handed in: which export one is, which can't be read, activity records, attachments, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.keys import stripped, title_of
from mnemospark.functions.text import plain_text
from mnemospark.session import ship

# What stands before and after a prompt in several languages, how feedback begins, products whose records count.
PROMPT_STARTS = ["Prompted ", "Asked ", "送信したメッセージ: ", "送信したメッセージ："]
PROMPT_ENDS = [" と入力しました", "と入力しました"]
FEEDBACK = ["フィードバックを送信しました", "Sent feedback"]
PRODUCTS = ["Gemini", "Bard"]
IMAGE = '(?i)<img[^>]*\\bsrc="([^"]+)"'
# How pointers to files begin, and media types by extension.
FILE_SERVICE = "file-service://"
MEDIA_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".heic": "image/heic",
    ".pdf": "application/pdf", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".wav": "audio/wav", ".mp4": "video/mp4", ".mov": "video/quicktime",
}

ACTIVITY = "header string, title string, time string, safeHtmlItem array<struct<html:string>>, subtitles array<struct<url:string>>, imageFile string, attachedFiles array<string>"


def export_kinds(spark: SparkSession, path: str) -> DataFrame:
    """path, kind of each JSON file, by the keys of its first element: tree, turns, activity, unknown, or unreadable."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    has = lambda key: F.try_variant_get("v", f"$[0].{key}", "variant").isNotNull()
    kind = F.when(F.col("v").isNull(), "unreadable").when(has("mapping"), "tree").when(has("chat_messages"), "turns").when(has("header") & has("time"), "activity").otherwise("unknown")
    return raw.select("path", kind.alias("kind"))


def shard_counts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """path, n, failed of each file of a sharded export: its threads, or that none could be read. rows: path, conv_id."""
    listed = spark.read.format("binaryFile").load(path).select("path")
    found = rows.groupBy("path").agg(F.count_distinct("conv_id").alias("n"))
    return listed.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("failed"))


def _stripped_prompt(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for end in reversed(PROMPT_ENDS):
        out = F.when(title.endswith(end), stripped(F.left(title, F.length(title) - len(end)))).otherwise(out)
    for start in reversed(PROMPT_STARTS):
        out = F.when(title.startswith(start), stripped(F.substring(title, len(start) + 1, 1 << 30))).otherwise(out)
    return F.coalesce(out, stripped(title))


def split_attachments(html: Column, links: Column, image: Column, files: Column) -> tuple[Column, Column]:
    """What the user gave and what the answer shows: images of the HTML are the answer's, all others the user's."""
    shown = F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(IMAGE), 1), lambda x: x != ""))
    given = F.array_distinct(F.filter(F.concat(F.coalesce(links, F.array()), F.array(image), F.coalesce(files, F.array())), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.array_except(given, shown), shown


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, title, position, role, text, created_at, attachments of activity records: a prompt and its answer.

    Records of other products, feedback, and records without a prompt or file of the user fall out.
    """
    ship(spark)
    raw = spark.read.schema(ACTIVITY).option("multiLine", True).json(path)
    raw = raw.where(F.coalesce(F.col("header").rlike("|".join(PRODUCTS)), F.lit(False)))
    title, html = F.coalesce("title", F.lit("")), F.coalesce(F.get("safeHtmlItem", F.lit(0))["html"], F.lit(""))
    feedback = F.lit(False)
    for start in FEEDBACK:
        feedback = feedback | title.startswith(start)
    given, shown = split_attachments(html, F.transform("subtitles", lambda s: s["url"]), F.col("imageFile"), F.col("attachedFiles"))
    rows = raw.where(~feedback).select("time", title.alias("t"), _stripped_prompt(title).alias("prompt"), plain_text(html).alias("answer"), given.alias("given"), shown.alias("shown"))
    rows = rows.where((F.col("prompt") != "") | (F.size("given") > 0))
    key = F.concat("time", F.lit("-"), F.left(F.sha2(F.concat_ws("|", "time", "t"), 256), F.lit(16)))
    name = title_of(F.when(F.col("prompt") != "", F.col("prompt")).when(F.col("answer") != "", F.col("answer")).otherwise("(添付のみ)"))
    turn = lambda role, text, files: F.struct(F.lit(role).alias("role"), F.col(text).alias("text"), F.col(files).alias("attachments"))
    turns = F.filter(F.array(turn("user", "prompt", "given"), turn("assistant", "answer", "shown")), lambda m: (m["role"] == "user") | (m["text"] != "") | (F.size(m["attachments"]) > 0))
    return rows.select(key.alias("conv_id"), name.alias("title"), F.col("time").try_cast("timestamp").alias("created_at"), F.posexplode(turns).alias("position", "m")).select("conv_id", "title", "position", "m.role", "m.text", "created_at", "m.attachments")


def resolved(pointers: DataFrame, blobs: DataFrame, names: DataFrame) -> DataFrame:
    """Pointers to files with their friendly name, media type, size and hash; those without bytes keep the size they state.

    pointers: pointer, size_bytes, ...; blobs: path, content; names: file, name (small: one row for each file of an export).
    """
    own = pointers.where(F.col("pointer").startswith(FILE_SERVICE)).withColumn("file", F.concat(F.substring("pointer", len(FILE_SERVICE) + 1, 1 << 30), F.lit(".dat")))
    there = blobs.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("hash")).dropDuplicates(["file"])
    rows = own.join(there, "file", "left").join(names, "file", "left").withColumn("name", F.coalesce("name", "file"))
    kind = F.lit(None).cast("string")
    for end, media in MEDIA_TYPES.items():
        kind = F.when(F.lower("name").endswith(end), media).otherwise(kind)
    return rows.withColumn("mime", kind).withColumn("size", F.coalesce("_size", "size_bytes")).drop("_size", "size_bytes", "file")


def inline_files(blocks: Column) -> Column:
    """mime, size, hash of the documents and images in a message's blocks that hold their bytes; broken ones fall out.

    blocks: array of struct type, source struct type, media_type, data.
    """
    own = F.filter(blocks, lambda b: b["type"].isin("document", "image") & (b["source"]["type"] == "base64"))
    bytes_ = lambda b: F.try_to_binary(b["source"]["data"], F.lit("base64"))
    return F.transform(F.filter(own, lambda b: bytes_(b).isNotNull()), lambda b: F.struct(b["source"]["media_type"].alias("mime"), F.length(bytes_(b)).alias("size"), F.sha2(bytes_(b), 256).alias("hash")))


def stored_once(files: DataFrame, stored: DataFrame) -> DataFrame:
    """hash, content of files whose content is not stored yet, once for each content."""
    own = files.select(F.sha2("content", 256).alias("hash"), "content")
    return own.groupBy("hash").agg(F.any_value("content").alias("content")).join(stored.select("hash"), "hash", "left_anti")


# Kinds of documents.
DOCUMENT_KINDS = ["lab_report", "imaging", "prescription", "letter", "other"]


def registered(files: DataFrame, stored: DataFrame) -> DataFrame:
    """sha, kind, name, size, status of documents handed in that are not yet there under their content and kind.

    files: name, kind, content; stored: sha, kind.
    """
    rows = files.select(F.sha2("content", 256).alias("sha"), "kind", "name", F.length("content").cast("long").alias("size"))
    first = rows.groupBy("sha", "kind").agg(F.min(F.struct("name", "size")).alias("r")).select("sha", "kind", "r.*")
    return first.join(stored.select("sha", "kind"), ["sha", "kind"], "left_anti").withColumn("status", F.lit("none"))


def with_extracts(documents: DataFrame, extracts: DataFrame) -> DataFrame:
    """Documents with the text taken from them; it stays a draft until a person has looked at it.

    extracts: sha, text, verified_by.
    """
    found = documents.drop("status").join(extracts, "sha", "left")
    status = F.when(F.col("text").isNull(), "none").when(F.coalesce(F.trim("verified_by"), F.lit("")) != "", "verified").otherwise("draft")
    return found.withColumn("status", status)


def catalog(metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias, metric: aliases, and each metric under its own name. An alias of an unknown metric is an error."""
    lost = aliases.join(metrics.select("metric"), "metric", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"alias {lost[0]['alias']!r} names an unknown metric")
    own = metrics.select(F.col("metric").alias("alias"), "metric")
    named = aliases.select(F.trim("alias").alias("alias"), "metric")
    return named.unionByName(own.join(named.select("alias"), "alias", "left_anti"))
