"""License scans: an exact set-similarity join of text blocks with license templates.

A block is ``BLOCK`` consecutive words, one starting at every ``STEP``-th word, so that a notice of up to STEP words stands
whole in some block however its lines are wrapped. The tokens of the templates are ordered by the number of texts of the
whole corpus that hold them, rare ones first. A block contains a template when it holds at least ``CONTAINMENT`` of its
distinct tokens. Only blocks that share a token of both prefixes are paired (prefix filter), that have enough tokens
(length filter), and whose tokens beyond the shared one can still suffice (position filter); those are then verified in
full.

Null texts count as empty; an empty text has no words, places or labels and scores 0. Repeated rows give repeated
results, also under one id or none. An empty table has no rows. Columns other than id and text don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

# Phrases whose words stand one after the other, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of public licenses.
TEMPLATES = {
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: The share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.9
#: Words in a block, and from one block's start to the next; both no less than twice and once the longest template.
BLOCK, STEP = 64, 32

#: A-Z to lower case; digits, letters and bytes beyond ASCII stay; all others end a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def _places(found: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> tuple[list[int], set[str]]:
    starts, labels = [], set()
    first = {p[0] for p in phrases}
    for i, word in enumerate(found):
        if word in first:
            for phrase, label in phrases.items():
                if tuple(found[i : i + len(phrase)]) == phrase:
                    starts.append(i)
                    labels.add(label)
    return starts, labels


def token_order(docs: DataFrame, tokens: set[bytes], text: str) -> dict[bytes, int]:
    """The rank of each template token by the number of texts with it, over all texts; rare ones first."""
    names = sorted(tokens)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(text).to_pylist():
                if value:
                    seen.update(tokens.intersection(words(value)))
        yield pa.RecordBatch.from_arrays([pa.array([names.index(t) for t in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    rows = map_batches(docs.select(text), run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # as many as the templates have tokens
    count = {names[r.token]: r.n for r in rows}
    return {t: i for i, t in enumerate(sorted(names, key=lambda t: (count.get(t, 0), t)))}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document: its words, the places and labels of phrases, and the templates that its blocks hold."""
    spark = docs.sparkSession
    sets = {label: set(words(t)) for label, t in templates.items()}
    rank = token_order(docs, set().union(*sets.values()), text)
    needed = {label: math.ceil(containment * len(s) - 1e-9) for label, s in sets.items()}
    least = min(needed.values())
    spoken = {tuple(words(p)): label for p, label in phrases.items()}
    hints = {p[-1] for p in spoken} | {p[0] for p in spoken}
    longest = max(len(words(t)) for t in templates.values())
    size, step = max(BLOCK, 2 * longest), max(STEP, longest)
    # The templates' prefixes: as many rows as the templates have tokens.
    prefix = []
    for label, s in sets.items():
        order = sorted(rank[t] for t in s)
        prefix += [(order[i], label, i, needed[label], order) for i in range(len(order) - needed[label] + 1)]
    rare = {t for t in rank if rank[t] in {p[0] for p in prefix}}

    def run(batches):
        for batch in batches:
            out = []
            for key, value in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                raw = (value or "").encode()
                found = raw.translate(_WORDS).split()
                starts, labels = _places(found, spoken) if hints.intersection(found) else ([], set())
                blocks = []
                if not rare.isdisjoint(found):  # prefix filter, for the whole text
                    for i, at in enumerate(range(0, max(len(found) - size + step, 1), step)):
                        held = rank.keys() & set(found[at : at + size])
                        if len(held) >= least and not rare.isdisjoint(held):  # length filter
                            blocks.append({"block": i, "tokens": sorted(rank[t] for t in held)})
                out.append((key, hashlib.blake2b(raw, digest_size=8).digest(), len(found), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), blocks))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [batch.schema.field(doc_id).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.int32()))]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["id", "digest", "n_words", "n_base", "first_word", "last_word", "phrase_labels", "blocks"]
    kind = docs.schema[doc_id].dataType.simpleString()
    found = materialize(map_batches(docs.select(doc_id, text), run, f"id {kind}, digest binary, n_words long, n_base long, first_word long, last_word long, phrase_labels array<string>, blocks array<struct<block:int,tokens:array<int>>>"), "licenses")

    prefix = spark.createDataFrame(prefix, "token int, label string, i int, needed int, template array<int>")
    blocks = found.where(F.size("blocks") > 0).select("id", "digest", F.explode("blocks").alias("b")).distinct().select("id", "digest", F.col("b.block").alias("block"), F.col("b.tokens").alias("tokens"), F.posexplode(F.slice("b.tokens", F.lit(1), F.size("b.tokens") - least + 1)).alias("j", "token"))
    b, t = F.size("tokens"), F.size("template")
    pairs = blocks.join(F.broadcast(prefix), "token").where((b >= F.col("needed")) & (F.col("j") <= b - F.col("needed")) & (F.least("i", "j") + 1 + F.least(t - F.col("i") - 1, b - F.col("j") - 1) >= F.col("needed")))
    held = F.size(F.array_intersect("tokens", "template"))
    verified = pairs.where(held >= F.col("needed")).groupBy("id", "digest").agg(F.sort_array(F.collect_set("label")).alias("template_labels"), F.max(held / t).alias("containment"))
    right = verified.withColumnsRenamed({"id": "id2", "digest": "digest2"})
    return (
        found.drop("blocks").join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left").drop("id2", "digest2", "digest")
        .withColumn("template_labels", F.coalesce("template_labels", F.array().cast("array<string>")))
        .withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))))
        .withColumnRenamed("id", doc_id)
    )
