"""Readers of command-line session logs, JSON lines, as rows: conv_id, title, position, role, text, created_at, cwd.

Lines keep their order by the place of their block in the file and their place in it. Lines that are no JSON fall out;
``bad_lines`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.keys import stripped, title_of

# How texts begin that a program put in, and what wraps a request from an editor.
WRAPPERS = ["<command-", "<local-command-", "<system-reminder>", "Caveat: The messages below"]
BOILERPLATE = ["<permissions instructions>", "<environment_context>", "<user_instructions>", "<turn_context>", "# AGENTS.md instructions", "<ENVIRONMENT_CONTEXT>"]
EDITOR, REQUEST = "# Context from my IDE setup", "## My request for Codex:"

SESSION = "type string, sessionId string, uuid string, isSidechain boolean, isMeta boolean, timestamp string, cwd string, summary string, message struct<content:variant>"
ROLLOUT = "timestamp string, type string, payload struct<id:string, timestamp:string, cwd:string, type:string, role:string, content:variant>"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return raw.where(stripped("value") != "").select("path", F.struct("_block", "_line").alias("at"), F.from_json("value", schema).alias("r"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of each file are no JSON."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(stripped("value") != "")
    return raw.where(F.try_parse_json("value").isNull()).groupBy("path").agg(F.count("*").alias("n"))


def _starts(text: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | text.startswith(prefix)
    return found


def _text(content: Column, kinds: list[str], clean) -> Column:
    """A text, or the texts of the blocks of some kinds, cleaned and joined by lines."""
    blocks = F.try_variant_get(content, "$", "array<struct<type:string, text:string>>")
    joined = F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"].isin(kinds)), lambda b: clean(stripped(b["text"]))), lambda t: t != ""), "\n")
    return F.when(F.schema_of_variant(content) == "STRING", clean(stripped(F.try_variant_get(content, "$", "string")))).otherwise(joined)


def _threads(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Numbers the messages of each file and adds what is known of the whole."""
    own = Window.partitionBy("path").orderBy("at")
    first = rows.groupBy("path").agg(F.min_by("text", F.struct(F.col("role") != "user", F.col("at"))).alias("_first"))
    found = rows.withColumn("position", F.row_number().over(own) - 1).join(first, "path").join(about, "path", "left")
    return found.select(F.coalesce("session", "path").alias("conv_id"), F.coalesce("summary", title_of(F.col("_first"))).alias("title"), "position", "role", "text", F.col("time").try_cast("timestamp").alias("created_at"), "cwd")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Logs of messages by user and assistant; side chains, notes of the program and its wrappers go.

    A file is one thread, named by its last summary or else by what the user first said.
    """
    rows = _lines(spark, path, SESSION).select("path", "at", "r.*")
    talk = rows.where(F.col("type").isin("user", "assistant") & ~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce("isMeta", F.lit(False)) & F.col("message").isNotNull())
    talk = talk.withColumn("text", _text(F.col("message.content"), ["text"], lambda t: t)).where("text <> ''").where(~((F.col("type") == "user") & _starts(F.col("text"), WRAPPERS)))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    about = talk.groupBy("path").agg(known("sessionId").alias("session"), known("cwd").alias("cwd"))
    named = rows.where("type = 'summary' AND summary <> ''").groupBy("path").agg(F.max_by("summary", "at").alias("summary"))
    return _threads(talk.select("path", "at", F.col("type").alias("role"), "text", F.col("timestamp").alias("time")), about.join(named, "path", "left"))


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Logs of items of which messages by user and assistant count; boilerplate goes, requests from an editor are unwrapped."""
    def clean(t: Column) -> Column:
        asked = F.when(F.contains(t, F.lit(REQUEST)), stripped(F.substr(t, F.instr(t, REQUEST) + len(REQUEST)))).otherwise("")
        return F.when(_starts(t, BOILERPLATE), "").when(t.startswith(EDITOR), asked).otherwise(t)

    rows = _lines(spark, path, ROLLOUT).select("path", "at", "r.*")
    talk = rows.where((F.col("type") == "response_item") & (F.col("payload.type") == "message") & F.col("payload.role").isin("user", "assistant"))
    talk = talk.select("path", "at", F.col("payload.role").alias("role"), _text(F.col("payload.content"), ["input_text", "output_text", "text"], clean).alias("text"), F.col("timestamp").alias("time")).where("text <> ''")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("at")))
    about = rows.where("type = 'session_meta'").groupBy("path").agg(last(F.col("payload.id")).alias("session"), last(F.col("payload.cwd")).alias("cwd"))
    return _threads(talk, about.withColumn("summary", F.lit(None).cast("string")))
