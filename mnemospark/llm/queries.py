"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import ship

from . import alignment, bpe, forced_bpe, html_text, lexical, licenses, media, mixing, ngram_join, quality, rules, sql, suffix_dedup, toxicity
from .common import read_table

#: The tail probability from which a document is kept, and the score from which one counts as toxic.
KEEP_TAIL, TOXIC = 0.5, 0.7


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return read_table(spark, sf_dir, "documents")


def token_digests(docs: DataFrame) -> DataFrame:
    path, pattern = tokenizer()
    coded = bpe.encode(docs.select("doc_id", "text"), path, pattern, back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    labels = F.array_sort(F.array_distinct(F.concat("phrase_labels", "template_labels")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read(media.store(_documents(spark, sf_dir).select("doc_id", "text")))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("pictures", lambda p: F.concat(p["width"].cast("string"), F.lit("x"), p["height"].cast("string"), F.lit(":"), p["thumb_hash"])), ",").alias("feature"),
    )


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("kept", F.col("tail") >= KEEP_TAIL)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return graded(spark, docs, sf_dir).drop("text")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").where(~held)
    model = toxicity.train(docs.where(~held), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_documents(spark, sf_dir), k=3, num=90, den=100)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    trusted = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    table = rules.ratios(docs, trusted)
    return rules.judge(docs, table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = html_text.extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_documents(spark, sf_dir), byte_tokenizer(), piece_tokenizer())
    return found.withColumnRenamed("digest", "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), k=20)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = forced_bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), byte_tokenizer(), packed=True, back=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_byte_bpe": op1,
    "op2_license_scan": op2,
    "op3_media_columns": op3,
    "op4_quality_classifier": op4,
    "op5_toxicity": op5,
    "op6_ngram_jaccard": op6,
    "op7_quality_rules": op7,
    "op8_html_extraction": op8,
    "op9_suffix_dedup": op9,
    "op10_source_mixing": op10,
    "op11_alignment": op11,
    "op12_ranked_search": op12,
    "op13_forced_bpe": op13,
}

#: Not here: op1, op3, op4, op5, op8, op11 and op13 (tokenizers, JPEG, models, HTML) and op7, whose hash DuckDB lacks.
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
