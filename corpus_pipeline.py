"""Five stages from raw documents to token digests, each an operator of mnemospark.llm.

Every stage works on all that the one before has kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import mixing, ngram_join, queries, suffix_dedup
from mnemospark.llm.common import materialize, read_table
from mnemospark.session import ship


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns apart, and all others in one, ``_row``: whatever their names, they meet no column of an operator."""
    return docs.select(*apart, F.struct(*(f"`{c}`" for c in docs.columns if c not in apart)).alias("_row"))


def _unpacked(found: DataFrame, columns: list[str], **apart) -> DataFrame:
    return found.select(*((apart[c] if c in apart else F.col("_row")[c]).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as texts without features; rows without an id are judged but not learned from; rows
    of equal text, repeated ones too, share one judgement. Without two grades among the labels all stay.
    """
    ship(spark)
    kept = queries.graded(spark, _packed(docs, "doc_id", "text"), sf_dir).where("kept")
    return _unpacked(kept, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, Jaccard of 0.8 or more) the row of the smallest id stays.

    Rows without an id come last: one stays where its group has no id at all. Of rows of one id and text one stays; of
    those of one id and several texts, one for each group. Texts without words, null ones too, are a group with their
    like of one id. Other columns don't decide; of rows alike in id and text the least by all columns stays.
    """
    ship(spark)
    # Rows are told apart by id and text, null-safe, so that a row's fate is that of its own text.
    key = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    columns, docs = docs.columns, _packed(docs, "doc_id", "text")
    keyed = docs.withColumn("_key", key)
    found = ngram_join.join_components(keyed.select("_key", "text"), "_key", k=5, num=80, den=100).groupBy("_key").agg(F.min("component_id").alias("group"))
    rows = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    placed = materialize(found.join(rows, "_key"), "placed")
    least = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("least")).select(F.col("least._key").alias("_key"), F.lit(True).alias("stays"))
    # Rows that go, and those of which one of several stays: few, so that whole texts need not be dealt out.
    marked = placed.join(least, "_key", "left").where("stays IS NULL OR n > 1").select("_key", F.col("stays").isNotNull().alias("stays"))
    marked = materialize(marked, "marked")
    kept = keyed.join(marked, "_key", "left_anti").select(*docs.columns)
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        one = keyed.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
        kept = kept.unionAll(one.select("row.*"))
    return _unpacked(kept, columns, doc_id=F.col("doc_id"), text=F.col("text"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go; documents of which nothing is left stay, empty.

    Null texts become empty ones. Rows without an id come after all others; rows of one id don't remove each other's
    bytes, so repeated rows stay alike.
    """
    ship(spark)
    left = suffix_dedup.remove_repeats(_packed(docs, "doc_id", "text"))
    return _unpacked(left, docs.columns, doc_id=F.col("doc_id"), text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have size 0, and so only the certain copies of their source; a null source is one of its own.
    Rows alike in id and text, without an id too, are taken together. An empty table has no rows.
    """
    ship(spark)
    taken = mixing.mix(_packed(docs, "doc_id", "text", "source"))
    return _unpacked(taken, docs.columns, **{c: F.col(c) for c in ("doc_id", "text", "source")})


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and decoded texts of all documents, as counts and digests.

    Null texts count as empty and have no ids; every row has one of its own, repeated rows and rows without an id too.
    """
    ship(spark)
    return queries.token_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: A trained classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
