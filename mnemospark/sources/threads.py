"""Readers of conversation exports as rows: conv_id, title, position, role, text, created_at.

Every reader has an explicit schema, so a file is read once; entries that don't fit it have null fields and fall out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.keys import stripped

TURNS = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string, sender:string, text:string, created_at:string, content:array<struct<type:string, text:string>>>>"
TREE = (
    "title string, create_time double, conversation_id string, current_node string, mapping map<string, struct<parent:string, message:struct<"
    "author:struct<role:string>, create_time:double, content:struct<content_type:string, parts:array<variant>, text:string>, metadata:struct<is_visually_hidden_from_conversation:boolean>>>>"
)


def _blank(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit(""))) == ""


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Gives what is left of each thread positions from 0, as an array step within the thread's own row."""
    turns = F.transform(order, lambda m, i: F.struct(i.alias("position"), m["role"].alias("role"), m["text"].alias("text"), m["created_at"].alias("created_at")))
    return rows.select("conv_id", "title", F.inline(turns))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Exports with a list of messages: text blocks are preferred over the plain text, blank messages go."""
    raw = spark.read.schema(TURNS).option("multiLine", True).json(path).where("uuid IS NOT NULL")

    def message(m: Column) -> Column:
        blocks = stripped(F.array_join(F.filter(F.transform(m["content"], lambda b: b["text"]), lambda t: ~_blank(t)), "\n"))
        text = F.when(~_blank(blocks), blocks).otherwise(stripped(m["text"]))
        role = F.when(m["sender"] == "human", "user").otherwise(m["sender"])
        return F.struct(role.alias("role"), text.alias("text"), m["created_at"].try_cast("timestamp").alias("created_at"))

    kept = F.filter(F.transform("chat_messages", message), lambda m: m["role"].isin("user", "assistant") & ~_blank(m["text"]))
    return _numbered(raw.select(F.col("uuid").alias("conv_id"), F.col("name").alias("title"), kept.alias("m")), "m")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _branch(nodes: pd.Series, parents: pd.Series, times: pd.Series, last: pd.Series) -> pd.Series:
    def of(ids, up, when, at):
        if ids is None:
            return None
        parent = dict(zip(ids, up, strict=True))
        if at not in parent:
            return [i for _, i in sorted(zip((t if t == t and t is not None else 0.0 for t in when), ids, strict=True), key=lambda x: x[0])]
        path: dict[str, None] = {}
        while at in parent and at not in path:
            path[at] = None
            at = parent[at]
        return list(path)[::-1]

    return pd.Series([of(*row) for row in zip(nodes, parents, times, last, strict=True)])


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose messages form a tree: the branch that ends in the current node, or all by time without one."""
    raw = spark.read.schema(TREE).option("multiLine", True).json(path).where("mapping IS NOT NULL")
    entries = raw.withColumn("e", F.map_entries("mapping"))
    order = _branch(F.transform("e", lambda x: x["key"]), F.transform("e", lambda x: x["value"]["parent"]), F.transform("e", lambda x: x["value"]["message"]["create_time"]), F.col("current_node"))

    def message(m: Column) -> Column:
        parts = F.transform(m["content"]["parts"], lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "string"))))
        kind = F.coalesce(m["content"]["content_type"], F.lit("text"))
        joined = F.array_join(F.filter(parts, lambda t: t != ""), "\n")
        text = F.when(kind.isin("text", "multimodal_text"), joined).when(kind == "user_editable_context", "").otherwise(m["content"]["text"])
        hidden = F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False))
        return F.struct(m["author"]["role"].alias("role"), stripped(text).alias("text"), F.timestamp_millis((m["create_time"] * 1000).cast("long")).alias("created_at"), hidden.alias("hidden"))

    turns = entries.select(F.col("conversation_id").alias("conv_id"), "title", "mapping", order.alias("o"))
    turns = turns.select("conv_id", "title", F.transform("o", lambda i: F.element_at("mapping", i)["message"]).alias("raw"))
    kept = F.filter(F.transform("raw", message), lambda m: m["role"].isin("user", "assistant") & ~m["hidden"] & ~_blank(m["text"]))
    return _numbered(turns.select("conv_id", "title", kept.alias("m")), "m")
