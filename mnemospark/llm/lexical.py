"""Ranked lexical search by pipelined term partitioning: item bundles pass from one owner of terms to the next.

Documents are cut into words once, in blocks of bounded size; a block's postings of the items' terms, sorted by term,
are a row of a written table. From it come the statistics over all documents (how many, how long, how often each term).
The terms are then dealt to owners, the rarest to the first. A bundle is a block's row of sparse accumulators, one list
of (document, score) for each item. It travels: at each stage it is cogrouped with what that owner holds for the
block, and the owner adds the integer contributions of its terms. The last owner hands on each item's best documents of
the block, of which a window selects the best of all.

Accumulators stay few and results whole: contributions are never negative and each term's largest one is known, so a
document is given up only when the sum of all that later owners could add leaves it below the k-th best score that the
block already has; for the same reason new documents stop coming in. Owners of common terms come last, so most
documents that hold only those are never sent from stage to stage.

Items are taken in passes of at most ``MOST_TERMS`` terms (more only for one item that has more by itself), which bounds
what is broadcast; each pass reads the documents again.

Null and empty texts have no terms: such documents are not counted and such items have no rows. Rows of ``items`` with
the same id and text are one item; the same id with another text is ranked apart, under the same id. Each row of ``docs``
is a document, so repeated rows tie and each takes a rank. Equal scores go by id, null ids last. Very long texts are a
batch of their own. Empty tables give no rows. Other columns are ignored. Words are compared by 64-bit hashes of their
bytes.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, list_array, map_batches, materialize, ragged, split_words, text_bytes, word_hashes

#: Documents and postings in a block at most (postings: but for one more batch).
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 2_000_000
#: Text that is cut into words at once, but for longer single texts.
BATCH_BYTES = 1_000_000
#: Stages of the pipeline. Each owner but the first has terms with so many times the postings of all before it.
OWNERS, SHARE = 4, 4
#: Terms of all items of one pass at most.
MOST_TERMS = 200_000

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def term_part(tf, m):
    """What a term's occurrences count for, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_part(n, docs: int, terms: int):
    return 75 + (25 * n * docs) // max(terms, 1)


def weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


class Items:
    """The items of a pass: their terms, hashed and sorted, and each item's terms with how often it has them."""

    def __init__(self, texts: list[list[str]]):
        self.names = sorted({t for terms in texts for t in terms})
        number = {t: i for i, t in enumerate(self.names)}
        raw = [t.encode() for t in self.names]
        ends = np.cumsum([len(r) for r in raw])
        hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.terms = [sorted(Counter(number[t] for t in terms).items()) for terms in texts]

    def deal(self, docs: int, df: dict[int, int], most_tf: dict[int, int], owners: int) -> None:
        """Gives each term a weight and an owner, and each item what the owners after each stage can add at most."""
        n = len(self.names)
        self.weights = np.array([weight(docs, df[t]) if t in df else 0 for t in range(n)], np.int64)
        rare_first = sorted(df, key=lambda t: (df[t], t))
        total, held, owner = sum(df.values()), 0, 0
        self.owner = np.zeros(n, np.int64)
        for t in rare_first:
            while owner < owners - 1 and held * SHARE ** (owners - 1 - owner) >= total:
                owner += 1
            self.owner[t] = owner
            held += df[t]
        top = [int(self.weights[t]) * term_part(most_tf.get(t, 1), 75) for t in range(n)]
        self.rest = np.array([[sum(c * top[t] for t, c in terms if self.owner[t] > s) for terms in self.terms] for s in range(owners)], np.int64).reshape(owners, len(self.terms))


def _blocks(docs: DataFrame, doc_id: str, text: str, items) -> DataFrame:
    """A row for each block: ids and lengths of its documents, and its postings by term."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, made, held, rows = TaskContext.get().partitionId(), 0, [], [0, 0]
        for batch in gathered(batches, text, BATCH_BYTES):
            data, offsets = text_bytes(batch.column(text))
            data = _LOWER[data]
            starts, ends, first = split_words(data, offsets, _OTHER)
            hashes, want = word_hashes(data, starts, ends), items.value
            at = np.minimum(np.searchsorted(want.hashes, hashes), max(len(want.hashes) - 1, 0))
            hit = np.flatnonzero(want.hashes[at] == hashes) if len(want.hashes) else np.zeros(0, np.int64)
            own = np.searchsorted(first, hit, "right") - 1
            key, tf = np.unique(own * len(want.names) + want.order[at[hit]] if len(hit) else np.zeros(0, np.int64), return_counts=True)
            for a in range(0, batch.num_rows, BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, batch.num_rows)
                if held and (rows[0] + b - a > BLOCK_DOCS or rows[1] > BLOCK_POSTINGS):
                    yield pack(part, made, held)
                    made, held, rows = made + 1, [], [0, 0]
                x, y = np.searchsorted(key, [a * len(want.names), b * len(want.names)])
                held.append((batch.column(doc_id).slice(a, b - a), np.diff(first[a : b + 1]), key[x:y] - a * len(want.names), tf[x:y]))
                rows = [rows[0] + b - a, rows[1] + y - x]
        if held:
            yield pack(part, made, held)

    def pack(part, number, held):
        width, before = max(len(items.value.names), 1), np.cumsum([0, *(len(h[1]) for h in held)])
        key, tf = np.concatenate([h[2] + b * width for h, b in zip(held, before[:-1], strict=True)]), np.concatenate([h[3] for h in held])
        order = np.argsort(key % width, kind="stable")
        key, tf, n = key[order], tf[order], np.concatenate([h[1] for h in held])
        terms, starts = np.unique(key % width, return_index=True)
        cut = np.append(starts, len(key))
        columns = {
            "block": pa.array([part << 32 | number]), "n_docs": pa.array([int((n > 0).sum())]), "n_terms": pa.array([int(n.sum())]),
            "ids": _one(pa.concat_arrays([h[0] for h in held])), "n": _one(pa.array(n, pa.int64())), "terms": _one(pa.array(terms, pa.int32())), "df": _one(pa.array(np.diff(cut), pa.int32())),
            "most_tf": _one(pa.array(np.maximum.reduceat(tf, starts) if len(starts) else [], pa.int32())), "docs": _one(pa.array(key // width, pa.int32())), "tf": _one(pa.array(tf, pa.int32())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"block long, n_docs long, n_terms long, ids array<{kind}>, n array<long>, terms array<int>, df array<int>, most_tf array<int>, docs array<int>, tf array<int>"
    return materialize(map_batches(docs.select(doc_id, text), run, schema), "lexical")


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return list_array(values, np.array([0, len(values)]))


def _held(blocks: DataFrame, owner: int, items) -> DataFrame:
    """What an owner holds: of each block, the postings of its terms."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].values.to_numpy()  # noqa: B023, E731
                terms, df = get("terms"), get("df").astype(np.int64)
                own = items.value.owner[terms] == owner
                if own.any():
                    at = ragged((np.cumsum(df) - df)[own], df[own])
                    columns = [batch.column("block").slice(i, 1), _one(pa.array(terms[own])), _one(pa.array(df[own], pa.int32())), _one(pa.array(get("docs")[at])), _one(pa.array(get("tf")[at]))]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "terms", "df", "docs", "tf"])

    return map_batches(blocks.select("block", "terms", "df", "docs", "tf"), run, "block long, terms array<int>, df array<int>, docs array<int>, tf array<int>")


def _visit(bundle: dict, held: dict | None, items: Items, owner: int, m: np.ndarray, k: int):
    """Each item's accumulators after this owner: (item, documents, scores, whether documents may still come in)."""
    size = len(m)
    if held is not None:
        cut = np.concatenate([[0], np.cumsum(held["df"])])
        gain = term_part(held["tf"].astype(np.int64), m[held["docs"]])
        place = {t: i for i, t in enumerate(held["terms"].tolist())}
    starts = dict(zip(bundle["items"].tolist(), range(len(bundle["items"])), strict=True))
    ends = np.concatenate([[0], np.cumsum(bundle["sizes"])])
    for j, terms in enumerate(items.terms):
        row = starts.get(j)
        was = slice(ends[row], ends[row + 1]) if row is not None else slice(0, 0)
        opened = bool(bundle["open"][row]) if row is not None else True
        here = [(place[t], c * int(items.weights[t])) for t, c in terms if items.owner[t] == owner and t in place] if held is not None else []
        if not here and row is None:
            continue
        score = np.zeros(size, np.int64)
        score[bundle["docs"][was]] = bundle["scores"][was]
        for p, w in here:
            score[held["docs"][cut[p] : cut[p + 1]]] += w * gain[cut[p] : cut[p + 1]]
        docs = np.flatnonzero(score) if opened else bundle["docs"][was]
        rest = int(items.rest[owner, j])
        if len(docs) >= k:
            best = int(np.partition(score[docs], len(docs) - k)[len(docs) - k])
            docs, opened = docs[score[docs] + rest >= best], opened and rest >= best
        yield j, docs, score[docs], opened


def _stage(items, owner: int, last: bool, n_docs: int, n_terms: int, k: int):
    """The owner's work on one bundle: it goes on as a bundle, or as each item's best documents from the last owner."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda table, name: table.column(name).combine_chunks()[0].values
        bundle = {c: get(left, c).to_numpy(zero_copy_only=False) for c in ("items", "sizes", "open", "docs", "scores")}
        held = {c: get(right, c).to_numpy() for c in ("terms", "df", "docs", "tf")} if right.num_rows else None
        ids, n = get(left, "ids"), get(left, "n").to_numpy()
        after = list(_visit(bundle, held, items.value, owner, length_part(n, n_docs, n_terms), k))
        if not last:
            docs, scores = (np.concatenate([np.zeros(0, np.int64), *(a[i] for a in after)]) for i in (1, 2))
            more = [pa.array([a[0] for a in after], pa.int32()), pa.array([len(a[1]) for a in after], pa.int32()), pa.array([a[3] for a in after], pa.bool_()), pa.array(docs, pa.int32()), pa.array(scores, pa.int64())]
            return pa.table([left.column("block"), left.column("ids"), left.column("n"), *map(_one, more)], names=["block", "ids", "n", "items", "sizes", "open", "docs", "scores"])
        out = [pa.table({"item": pa.array([], pa.int32()), "doc": pa.array([], ids.type), "score": pa.array([], pa.int64())})]
        for j, docs, scores, _ in after:
            best = ids.take(pa.array(docs))
            order = pa.compute.sort_indices(pa.table({"score": scores, "doc": best}), [("score", "descending"), ("doc", "ascending")])[:k]
            out.append(pa.table({"item": pa.array(np.full(len(order), j), pa.int32()), "doc": best.take(order), "score": pa.array(scores).take(order)}))
        return pa.concat_tables(out)

    return visit


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", owners: int = OWNERS) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    if k < 1 or owners < 1:
        raise ValueError("k and owners must be 1 or more")
    asked = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("of")).distinct().where(F.col("of").isNotNull())
    asked = materialize(asked.select("item", F.xxhash64("item", "of").alias("key"), F.regexp_extract_all(F.translate("of", _UPPER, _LOWERED), F.lit(WORD), F.lit(0)).alias("terms")).where(F.size("terms") > 0), "items")
    passes = 1
    while True:
        dealt = asked.groupBy(F.pmod("key", F.lit(passes)).alias("pass")).agg(F.sum(F.size("terms")).alias("n"), F.countDistinct("key").alias("items"))
        if not dealt.where((F.col("n") > MOST_TERMS) & (F.col("items") > 1)).limit(1).count():
            break
        passes *= 2
    found = None
    for p in range(passes):
        some = _ranked(docs, asked.where(F.pmod("key", F.lit(passes)) == p).collect(), k, doc_id, text, owners, asked.schema["item"].dataType.simpleString())
        found = some if found is None else found.unionByName(some)
    return found.withColumnsRenamed({"item": item_id, "doc": doc_id})


def _ranked(docs: DataFrame, rows: list, k: int, doc_id: str, text: str, owners: int, item_kind: str) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    items = Items([r.terms for r in rows])
    blocks = _blocks(docs, doc_id, text, spark.sparkContext.broadcast(items))
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    seen = blocks.select(F.explode(F.arrays_zip("terms", "df", "most_tf")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"), F.max("t.most_tf").alias("most")).collect()  # a row for each term of the pass at most
    items.deal(n_docs, {r.terms: r.df for r in seen}, {r.terms: r.most for r in seen}, owners)
    shared = spark.sparkContext.broadcast(items)

    carried = f"block long, ids array<{kind}>, n array<long>, items array<int>, sizes array<int>, open array<boolean>, docs array<int>, scores array<long>"
    empty = [F.array().cast(c).alias(n) for n, c in (("items", "array<int>"), ("sizes", "array<int>"), ("open", "array<boolean>"), ("docs", "array<int>"), ("scores", "array<long>"))]
    bundles = blocks.select("block", "ids", "n", *empty)
    for owner in range(owners):
        last = owner == owners - 1
        held = _held(blocks, owner, shared)
        bundles = bundles.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_stage(shared, owner, last, n_docs, n_terms, k), f"item int, doc {kind}, score long" if last else carried)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number int, item {item_kind}")  # the items of a pass
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    best = bundles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumnRenamed("item", "number").join(F.broadcast(names), "number").select("item", "rank", "doc", "score")
