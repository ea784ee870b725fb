"""Quality rules in DataFrame functions alone: repetition and symbol counts, and a log-likelihood ratio of hashed n-grams.

The n-grams of all texts are hashed into buckets and counted twice: over the trusted target and over the raw corpus. A
document's score is the mean, over its n-grams, of the logarithm of the ratio of both smoothed multinomials. Every document is held against the same threshold.

Null and empty texts have no words, fail the base rules and score 0. Repeated rows get the same values. With an empty
target, all ratios are those of the smoothing alone. Other columns pass through; those named like an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words, and the characters that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"

BUCKETS = 8192
#: Words in an n-gram.
NGRAM = 1
#: Added to each bucket's share of the counts, as this fraction of an even share.
SMOOTHING = 0.5
#: Documents of a lower mean log-likelihood ratio are not kept.
THRESHOLD = -0.25
#: Windows of so many words found twice in one text count as repeated.
WINDOW = 3

def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """Words inside windows that the text holds twice or more. hashes: 64-bit ones of the words; windows have such too."""
    windows = _bound(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    def positions(h: Column) -> Column:
        """Places of windows that are not the only one of their hash."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _bound(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def covered(h: Column) -> Column:
        return _bound(positions(h), lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"])

    plain = _bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(hashes) < WINDOW + 1, 0).otherwise(plain).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = [c for c in docs.columns if c not in names]
    found = _counted(docs.select(F.col(f"`{text}`").alias("text"), F.struct(*(f"`{c}`" for c in rest)).alias("row")))
    return found.select(*(F.col("row")[c].alias(c) for c in rest), *names)


def _counted(own: DataFrame) -> DataFrame:
    """The counts of text, beside row, and the hashes of its words."""
    value = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (
        own.withColumn("words", words_of(F.col("text")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(value) - F.length(F.regexp_replace(value, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("n_repeat_words", repeated_words(F.col("hashes")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _buckets(hashes: Column) -> Column:
    """The bucket of each n-gram; one word is a 1-gram."""
    grams = hashes
    for k in range(1, NGRAM):
        grams = F.zip_with(grams, F.slice(hashes, F.lit(k + 1), F.greatest(F.size(hashes) - k, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.transform(grams if NGRAM == 1 else F.array_compact(grams), lambda h: F.pmod(h, F.lit(BUCKETS)))


def ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING) -> DataFrame:
    """One row: ``table array<double>``, the log ratio of each bucket. trusted: the ids of the target.

    What meets the ids are bucket numbers, not texts.
    """
    hashed = docs.select(F.col(doc_id).alias("i"), _buckets(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))).cast("array<smallint>").alias("b"))
    ids = trusted.select(F.col(doc_id).alias("i")).where("i IS NOT NULL").distinct().withColumn("t", F.lit(True))
    # Merged at every size: the ids grow with the corpus.
    counts = hashed.join(ids.hint("merge"), "i", "left").select(F.coalesce("t", F.lit(False)).alias("t"), F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("good"))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "b").join(counts, "b", "left").fillna(0)
    total = every.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    s = F.lit(smoothing)
    share = lambda n, all_: (F.col(n) + s) / (F.col(all_) + s * BUCKETS)
    return every.crossJoin(F.broadcast(total)).select("b", F.ln(share("good", "goods") / share("raw", "raws")).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "r"))), lambda x: x["r"]).alias("table"))


def judge(docs: DataFrame, table: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, ``llr double`` and ``kept boolean``. table: one row of BUCKETS numbers, from ratios()."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    rest = [c for c in docs.columns if c not in names]
    n = F.greatest(F.col("n_words") - (NGRAM - 1), F.lit(1))
    total = F.aggregate(_buckets(F.col("hashes")), F.lit(0.0), lambda a, b: a + F.get(F.col("ratios"), b.cast("int")))
    found = _counted(docs.select(F.col(f"`{text}`").alias("text"), F.struct(*(f"`{c}`" for c in rest)).alias("row"))).crossJoin(F.broadcast(table.select(F.col("table").alias("ratios"))))
    found = found.withColumn("llr", total / n).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return found.select(*(F.col("row")[c].alias(c) for c in rest), *names)
