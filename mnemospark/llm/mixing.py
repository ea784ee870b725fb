"""Mixing sources to target weights: Pareto order sampling, in DataFrame functions alone.

Each source gets a share of all words by its weight, at most ``MOST`` times its own size; what is beyond goes to the
others by weight. A source whose target is f times its size takes floor(f) certain copies of every document; the
rest is a sample of unequal probabilities: with inclusion probability p, larger for larger documents, and a random u
from a hash, documents are taken in the order of (u / (1 - u)) / (p / (1 - p)) as long as they fit the source's words; one more
fills the gap that is left, where a document's size comes near it.

The order statistics are taken in two steps, first over buckets of the order, then in the one bucket that holds the
boundary, so that no source, however large, goes through one task. Null texts have size 0, a null source is a source
of its own and comes last. Rows that are alike in id and text are tied and taken together. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The words' pattern, the weights of the sources by code point, repeating, and the cap on repeats.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3

BUCKETS = 1 << 14
SEED = "pareto-1"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_of(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id and the text."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target. sizes: one row for each source."""
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    # Sources reach their caps in the order of cap / weight; those before a source are at their caps when its turn comes.
    turn = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("all", F.sum("source_size").over(whole))
    ranked = ranked.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    capped = F.col("cap") <= F.col("level") * F.col("w")
    ranked = ranked.withColumn("capped", capped)
    rest = F.max(F.when(~F.col("capped"), F.struct((-F.col("cap") / F.col("w")).alias("a"), (-F.col("k")).alias("b"), F.col("level").alias("level")))).over(whole)["level"]
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * rest)).select("source", "source_size", "n_docs", "target")


def _order(u: Column, size: Column, rest: Column, source_size: Column, n_docs: Column) -> Column:
    """Random odds over inclusion odds. The inclusion probability goes with the square root of the size."""
    p = F.greatest(F.least(rest * F.sqrt(size * n_docs / source_size), F.lit(0.999999)), F.lit(0.000001))
    return (u / (1 - u)) / (p / (1 - p))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each row's id and source with ``size``, ``source_size``, ``target`` and ``copies``; ``u`` tells rows apart."""
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), random_of(F.col(doc_id), F.col(text)).alias("u")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("certain", F.floor(fraction + 1e-12)).withColumn("rest", F.greatest(fraction - F.col("certain"), F.lit(0.0)))
    sources = materialize(sources.withColumn("budget", F.col("rest") * F.col("source_size")), "mix-sources").withColumnRenamed("source", "s")  # one row for each source
    same = F.col("source").eqNullSafe(F.col("s"))
    # Buckets of the order: x / (1 + x) maps it to (0, 1).
    placed = sized.join(sources, same).where("size > 0 AND rest > 0").withColumn("q", _order(F.col("u"), F.col("size"), F.col("rest"), F.col("source_size"), F.col("n_docs")))
    placed = placed.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
    own = Window.partitionBy("s").orderBy("bucket")
    sums = placed.groupBy("s", "bucket", "budget").agg(F.sum("size").alias("n")).withColumn("end", F.sum("n").over(own))
    edge = sums.where((F.col("end") > F.col("budget")) & (F.col("end") - F.col("n") <= F.col("budget"))).select(F.col("s").alias("s2"), F.col("bucket").alias("edge"), (F.col("end") - F.col("n")).alias("base"))
    edge = materialize(edge, "mix-edges")  # one row for each source
    inside = placed.join(edge, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("edge")))
    tied = inside.groupBy("s", "q", "base", "budget").agg(F.sum("size").alias("n"))
    run = F.col("base") + F.sum("n").over(Window.partitionBy("s").orderBy("q"))
    last = tied.withColumn("run", run).where("run <= budget").groupBy("s").agg(F.max("q").alias("last"), F.max("run").alias("run"))
    cut = sources.join(edge, F.col("s").eqNullSafe(F.col("s2")), "left").join(last.withColumnRenamed("s", "s3"), F.col("s").eqNullSafe(F.col("s3")), "left")
    # What is then still missing; without an edge everything was taken.
    cut = materialize(cut.withColumn("gap", F.when(F.col("edge").isNotNull(), F.col("budget") - F.coalesce("run", "base"))).select("s", "source_size", "n_docs", "target", "certain", "rest", "edge", "last", "gap"), "mix-cuts")
    q = _order(F.col("u"), F.col("size"), F.col("rest"), F.col("source_size"), F.col("n_docs"))
    bucket = F.floor(q / (1 + q) * BUCKETS)
    more = F.when((F.col("size") == 0) | (F.col("rest") <= 0), False).when(F.col("edge").isNull() | (bucket < F.col("edge")), True).when(bucket > F.col("edge"), False).otherwise(F.coalesce(q <= F.col("last"), F.lit(False)))
    judged = sized.join(cut, same).withColumn("q", q).withColumn("more", more)
    # One more document fills the gap, the one whose size comes nearest to it.
    off = F.abs(F.col("size") - F.col("gap"))
    fill = judged.where(~F.col("more") & (F.col("size") > 0) & (off < F.col("gap"))).groupBy("s").agg(F.min(F.struct(off.alias("off"), F.col("q").alias("q"))).alias("f")).select(F.col("s").alias("s4"), F.col("f.q").alias("fill"))
    taken = judged.join(fill, F.col("s").eqNullSafe(F.col("s4")), "left").withColumn("more", F.col("more") | F.coalesce((F.col("q") == F.col("fill")) & (F.col("size") > 0), F.lit(False)))
    return taken.select("doc_id", "source", "size", "u", "source_size", "target", (F.col("certain") + F.col("more").cast("int")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its columns."""
    copies = plan(docs, doc_id, text, source, weights, most).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("u").alias("_u"), "copies").distinct()
    placed = docs.withColumn("_r", random_of(F.col(doc_id), F.col(text)))
    taken = placed.join(copies, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_u")))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
