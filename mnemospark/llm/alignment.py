"""Cross-tokenizer alignment: each distinct text is tokenised and aligned once, its pairs weighted by its copies.

Texts are shuffled whole and grouped, so copies meet and only their number goes on. Each distinct text is encoded by a
byte-level BPE (A, of a space and the text) and by a piece model (B, which adds the space). Where tokens of both end at
the same byte, they cut the text into groups; every A token of a group is linked with every B token of it.

How many documents hold a pair of ids linked is counted over blocks. A block is a bounded number of texts, and beside
them the distinct pairs in them with the sum of the texts' copies. Only these are shuffled by pair: a pair has one row
for a block at most, however many texts hold it, so a pair that all documents hold makes no hot key. Counts and the
highest count of each A id (a window over at most as many pairs as B has ids) go back to the blocks by the same way, and
each block's texts look them up, cogrouped by block. At last the measures are joined to the documents by the text's
SHA-256; a text with very many copies is one row on one side, and Spark splits the other.

Texts that are null, empty, or whose tokens of A or B do not spell a space and the text have no tokens: zeros, and ''
as digest. Each row is a document, so repeated rows count and each gets its measures. A very long text is a batch of its
own. An empty table gives no rows. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import workers

from .common import gathered, list_array, map_batches, materialize, ragged
from .forced_bpe import Encoder, Vocabulary

#: Text that is aligned at once, but for longer single texts.
BATCH_BYTES = 1_000_000
#: Distinct pairs of all texts of a block, but for the last batch's.
BLOCK_PAIRS = 1_500_000

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Both tokenizers in a worker, with the bytes of their tokens."""

    def __init__(self, vocabulary: Vocabulary, model: bytes):
        import sentencepiece

        self.a, self.b = Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.tokens = pa.array(vocabulary.tokens, pa.large_binary()), pa.array(pieces, pa.large_binary())
        self.width = 1 << (len(pieces) - 1).bit_length()
        if len(vocabulary.tokens) * self.width >= 1 << 31:
            raise ValueError("pairs of ids must fit in 31 bits")
        # Each id as text with what may follow it in a group: a comma or the group's next part.
        self.words = pa.array([f"{i}{end}" for i in range(len(vocabulary.tokens)) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;"], pa.large_string())

    def batch(self, texts: list[str]) -> dict:
        """Ids, groups and distinct pairs of each text, of none where the tokens do not spell it."""
        coded = self.a.encode([" " + t for t in texts], plain=True), self.b.encode(texts, num_threads=1)
        a, b = np.frombuffer(b"".join(coded[0]), "<i4").astype(np.int64), np.fromiter(chain.from_iterable(coded[1]), np.int64)
        n_a, n_b = np.array([len(x) // 4 for x in coded[0]]), np.array([len(x) for x in coded[1]])
        size_a, size_b, good = self._spelt(texts, a, n_a, b, n_b)
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        a, b, size_a, size_b, n_a, n_b = a[keep_a], b[keep_b], size_a[keep_a], size_b[keep_b], n_a * good, n_b * good
        # Bytes of all texts lie one after the other, so a text's end is a group's end too.
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        text_a = np.repeat(np.arange(len(texts)), n_a)
        links = in_b[group_a]
        pair = np.repeat(a, links) * self.width + b[ragged((np.cumsum(in_b) - in_b)[group_a], links)]
        held, many = np.unique(np.repeat(text_a, links) << 31 | pair, return_counts=True)
        per = lambda x, w=None: np.bincount(x, w, len(texts)).astype(np.int64)
        # A group's tokens, those of A before those of B.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.tokens[0]) + 2 * b + last_b
        return {"n_a": n_a, "n_b": n_b, "n_groups": per(text_a[last_a]), "n_links": per(text_a, links), "groups": self._written(order, n_a + n_b), "text": held >> 31, "pair": (held & 0x7FFFFFFF).astype(np.int32), "links": many.astype(np.int32)}

    def _spelt(self, texts: list[str], a, n_a, b, n_b):
        """Bytes of each token, and which texts both tokenizers spell."""
        out, want = [], [b" " + t.encode() if t else b"" for t in texts]
        good = np.array([bool(t) for t in texts], bool)
        for tokens, ids, counts in ((self.tokens[0], a, n_a), (self.tokens[1], b, n_b)):
            raw, at = _joined(tokens.take(pa.array(ids)))
            ends = at[np.concatenate([[0], np.cumsum(counts)])].tolist()
            good &= [raw[x:y] == w for x, y, w in zip(ends[:-1], ends[1:], want, strict=True)]
            out.append(np.diff(at))
        return *out, good

    def _written(self, order: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        raw, at = _joined(self.words.take(pa.array(order)))
        ends = at[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _joined(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values, one after the other, and where each begins (one more entry at the end)."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if offsets is not None else np.zeros(1, np.int64)
    return (data.to_pybytes() if data is not None else b""), offsets


def _aligned(texts: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """A row for each text, and for each block one without an id that holds its pairs and the copies of texts with each."""
    spark = texts.sparkSession
    with open(path_b, "rb") as f:
        shared = spark.sparkContext.broadcast((Vocabulary(path_a), f.read()))  # bounded by the tokenizers' files
    names = ["id", "block", "copies", *MEASURES, "digest", "pairs", "amounts", *(["groups"] if with_groups else [])]

    def run(batches):
        from pyspark import TaskContext

        part, block, held, many = TaskContext.get().partitionId() << 32, 0, [], 0
        aligners = workers.memory("alignment")
        if path_a + path_b not in aligners:
            aligners[path_a + path_b] = Aligner(*shared.value)
        own = aligners[path_a + path_b]
        for batch in gathered(batches, "text", BATCH_BYTES):
            texts, copies = batch.column("text").to_pylist(), batch.column("copies").to_numpy()
            found = own.batch(texts)
            cut = np.searchsorted(found["text"], np.arange(len(texts) + 1))
            columns = {
                "id": pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()), "block": pa.array(np.full(len(texts), part | block)), "copies": batch.column("copies"), **{m: pa.array(found[m]) for m in MEASURES},
                "digest": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]), "pairs": list_array(pa.array(found["pair"]), cut), "amounts": list_array(pa.array(found["links"].astype(np.int64)), cut), "groups": pa.array([g.decode() for g in found["groups"]] if with_groups else []),
            }
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)
            held.append(_summed(found["pair"], copies[found["text"]]))
            many += len(found["pair"])
            if many > BLOCK_PAIRS:
                yield whole(part | block, held)
                block, held, many = block + 1, [], 0
        if held:
            yield whole(part | block, held)

    def whole(block, held):
        pairs, copies = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        one = {"id": pa.array([None], pa.binary()), "block": pa.array([block]), "pairs": list_array(pa.array(pairs), np.array([0, len(pairs)])), "amounts": list_array(pa.array(copies), np.array([0, len(pairs)]))}
        return pa.RecordBatch.from_arrays([one[n] if n in one else pa.array([None], pa.string() if n in ("digest", "groups") else pa.int64()) for n in names], names)

    schema = f"id binary, block long, copies long, {', '.join(f'{m} long' for m in MEASURES)}, digest string, pairs array<int>, amounts array<long>{', groups string' if with_groups else ''}"
    return materialize(map_batches(texts, run, schema, "alignment"), "alignment")


def _summed(pairs: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, amounts = pairs[order], amounts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(amounts, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, how many documents hold it linked, and whether no pair of the same A id has more."""
    held = rows.where(F.col("id").isNull()).select(F.explode(F.arrays_zip("pairs", "amounts")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.amounts").alias("documents"))
    most = F.max("documents").over(Window.partitionBy((F.col("pair") / width).cast("int")))
    return counts.withColumn("best", F.col("documents") == most)


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """Measures of a block's texts from the counts of its pairs."""
    key, documents, best = (right.column(c).to_numpy() for c in ("pair", "documents", "best"))
    order = np.argsort(key)
    pairs, amounts = left.column("pairs").combine_chunks(), left.column("amounts").combine_chunks()
    sizes = pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(left.num_rows), sizes)
    at, links = order[np.searchsorted(key, pairs.flatten().to_numpy(), sorter=order)] if len(own) else np.zeros(0, np.int64), amounts.flatten().to_numpy()

    def summed(values):
        out = np.zeros(left.num_rows, np.int64)
        np.add.at(out, own, values)
        return pa.array(out)

    return left.drop_columns(["pairs", "amounts", "block"]).append_column("n_best", summed(links * best[at])).append_column("count_sum", summed(links * documents[at]))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest (of the groups as text), and these as
    ``groups`` if asked for."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    texts = given.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    rows = _aligned(texts, path_a, path_b, with_groups)
    import sentencepiece

    width = 1 << (sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size() - 1).bit_length()
    in_block = rows.where(F.col("id").isNull()).select(F.col("block").alias("in_block"), F.explode("pairs").alias("pair")).join(pair_counts(rows, width), "pair")
    out = ["id", *MEASURES, "digest", *(["groups"] if with_groups else [])]
    kinds = ", ".join(["id binary", *(f"{m} long" for m in MEASURES), "digest string", *(["groups string"] if with_groups else []), "n_best long", "count_sum long"])
    measured = rows.where(F.col("id").isNotNull()).select("block", "pairs", "amounts", *out).groupBy("block").cogroup(in_block.groupBy("in_block")).applyInArrow(_look_up, kinds)
    found = given.select("doc", F.when(F.length("text") > 0, F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("id")).join(measured, "id", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return found.select(F.col("doc").alias(doc_id), *zeros, *(F.coalesce(c, F.lit("")).alias(c) for c in out[5:]))
