"""Derived tables brought up to date: chunks, vectors, postings and links of what is new or changed, and of nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators import archive, items, search


def gaps_filled(units: DataFrame, chunks: DataFrame, version: str, vectors: DataFrame, model: tuple[str, str], encoder, links: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """Rows to be added to each derived table: ``chunks``, ``vectors``, ``postings``; and all ``links``, made anew.

    units: unit_id, text; chunks: unit_id, version; vectors: unit_id, provider, model, unit_id that of the unit; model:
    provider and model; encoder: None without one, then search goes by words alone; links: item, via, key.
    """
    todo = items.unchunked(units, chunks, version, force)
    made = text.chunks(todo, "text", ["unit_id"]).withColumn("version", F.lit(version))
    new = search.embedded(units, vectors, *model, encoder) if encoder is not None else vectors.limit(0)
    return {"chunks": made, "vectors": new, "postings": search.postings(made.select("unit_id", F.col("chunk").alias("text"))), "links": archive.linked_pairs(links)}


def after_import(actions: DataFrame, fresh: DataFrame, key: str, **derived) -> dict[str, DataFrame]:
    """gaps_filled() for the rows of an import that are new or changed. actions: from items.plan()."""
    changed = actions.where("action <> 'skip'").select(F.col(key).alias("unit_id"))
    units = fresh.withColumnRenamed(key, "unit_id").join(changed, "unit_id", "left_semi")
    stale = {name: derived[name].join(changed, "unit_id", "left_anti") for name in ("chunks", "vectors")}
    return gaps_filled(units, **{**derived, **stale})
