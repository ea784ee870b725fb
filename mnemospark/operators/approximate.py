"""Approximate nearest neighbours: inverted lists of product-quantised codes, exact scores for the best of them.

Every vector stands in the list of its nearest cell, as a code of one byte for each four numbers of what the cell's middle
leaves of it. A query looks into the lists of the cells nearest to it, scores their codes by tables of 256 products
for each byte, and reads only the best ``rerank`` vectors themselves. Cells and codes are fitted on a bounded sample;
all vectors are indexed, in blocks that are made where the vectors are read, without a shuffle. Blocks of a large cell
are dealt over salts, to each of which the cell's queries go. Exact search is ``search.nearest``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.values import cosine
from mnemospark.operators.search import batches_of
from mnemospark.session import kept, ship
from mnemospark.workers import tidy

#: Vectors that are fitted on, at most: those of the smallest hashes of their ids. Rounds of the fit, and the share of a sample
#: vector's NEAR nearest sample vectors that the cells it looks into must hold.
SAMPLE, ROUNDS, RECALL, NEAR = 8_192, 10, 0.99, 10
#: Cells at most, numbers that a byte of a code stands for, vectors of a block, queries of a pack, blocks of a cell for one task.
MOST_CELLS, PART, BLOCK, PACK, TASK_BLOCKS = 4096, 4, 1024, 256, 256
#: Vectors that are scored exactly for each query, and scores that a task holds before it passes them on.
RERANK, HELD = 100, 1 << 21


@dataclass
class Model:
    """Middles of cells, 256 pieces for each part of a vector, and into how many cells a query looks."""

    middle: np.ndarray
    pieces: np.ndarray
    probes: int

    def padded(self, rows: np.ndarray) -> np.ndarray:
        size = self.middle.shape[1]
        return np.pad(rows, ((0, 0), (0, size - rows.shape[1]))) if rows.shape[1] <= size else rows[:, :size]

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector and its code."""
        cell = (rows @ self.middle.T).argmax(1)
        left = (rows - self.middle[cell]).reshape(len(rows), -1, PART)
        codes = np.empty(left.shape[:2], np.uint8)
        for m, pieces in enumerate(self.pieces):
            codes[:, m] = (left[:, m] @ pieces.T - (pieces**2).sum(1) / 2).argmax(1)
        return cell, codes

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the cosine of each query with each coded vector of a cell."""
        tables = np.einsum("qmp,mkp->mqk", queries.reshape(len(queries), -1, PART), self.pieces)
        out = np.repeat((queries @ self.middle[cell])[:, None], len(codes), 1)
        for m, table in enumerate(tables):
            out += table[:, codes[:, m]]
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _means(rows: np.ndarray, n: int) -> np.ndarray:
    """Middles of n clusters by squared distance, started from the first rows; of fewer rows these themselves, repeated."""
    middle = np.resize(rows[:n], (n, rows.shape[1])).copy()
    for _ in range(ROUNDS if len(rows) > n else 0):
        near = (rows @ middle.T - (middle**2).sum(1) / 2).argmax(1)
        count = np.bincount(near, minlength=n)
        summed = np.zeros_like(middle)
        np.add.at(summed, near, rows)
        middle[count > 0] = summed[count > 0] / count[count > 0, None]
    return middle


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Model | None:
    """A model of vectors (vec_id, v), or None where there are none.

    cells: half the root of their number unless given. A query looks into as many cells as hold the share ``recall`` of
    the sample's near neighbours, for each sample vector in turn.
    """
    given = vectors.where("v IS NOT NULL AND size(v) > 0")
    rows = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not rows:
        return None
    size = max(len(r.v) for r in rows)
    own = _unit(np.nan_to_num(np.array([list(r.v) + [0.0] * (-(-size // PART) * PART - len(r.v)) for r in rows], np.float64)))
    cells = min(cells or max(int(given.count() ** 0.5) // 2, 1), MOST_CELLS, max(len(own) // 16, 1))
    middle = _means(own, cells)
    cell = (own @ middle.T).argmax(1)
    left = (own - middle[cell]).reshape(len(own), -1, PART)
    pieces = np.stack([_means(left[:, m], 256) for m in range(left.shape[1])])
    asked = own[: min(len(own), 500)]
    near = np.argsort(-(asked @ own.T), axis=1, kind="stable")[:, :NEAR]
    order = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    place = np.take_along_axis(order, cell[near], 1)
    return Model(middle, pieces, int(np.ceil(np.quantile(place, recall))) + 1)


def _rows(column: pa.Array, model: Model) -> np.ndarray:
    values = [[0.0 if x is None else x for x in v] for v in column.to_pylist()]
    size = model.middle.shape[1]
    return _unit(np.array([(v + [0.0] * size)[:size] for v in values], np.float64).reshape(len(values), size))


def index(vectors: DataFrame, model: Model) -> DataFrame:
    """Blocks of coded vectors of one cell: cell, block, ids, codes. Null vectors are in none."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by MOST_CELLS and 256 pieces a part

    def run(batches):
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def block(cell):
            ids, codes = held.pop(cell)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part | made]), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)), pa.array([b"".join(codes)])], ["cell", "block", "ids", "codes"])

        for batch in batches:
            cells, codes = shared.value.code(_rows(batch.column("v"), shared.value))
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                ids, own = held.setdefault(cell, ([], []))
                ids.append(batch.column("vec_id").take(pa.array(at)))
                own.append(codes[at].tobytes())
                if sum(map(len, ids)) >= BLOCK:
                    yield block(cell)
                    made += 1
        for cell in list(held):
            yield block(cell)
            made += 1

    return vectors.where("v IS NOT NULL").select("vec_id", "v").mapInArrow(tidy(run), f"cell int, block long, ids array<{kind}>, codes binary")


def _packs(queries: DataFrame, model, probes: int | None) -> DataFrame:
    """For each cell the queries that look into it, some in a row: cell, qids, numbers."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        # A batch has at most PACK queries, so those of a cell are a pack, and none is held for the next batch.
        for batch in batches:
            rows = _rows(batch.column("qv"), model.value)
            near = np.argsort(-(rows @ model.value.middle.T), axis=1, kind="stable")[:, : probes or model.value.probes]
            for cell in np.unique(near).tolist():
                at = np.flatnonzero((near == cell).any(1))
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column("query_id").take(pa.array(at))), pa.array([rows[at].tobytes()])], ["cell", "qids", "numbers"])

    return queries.where("qv IS NOT NULL").select("query_id", "qv").mapInArrow(tidy(run), f"cell int, qids array<{kind}>, numbers binary")


def _candidates(model, rerank: int):
    """The best codes of each query among the blocks of a task, passed on whenever HELD scores are held."""

    def out(held):
        for qids, score, keys in held.values():
            at = np.repeat(np.arange(len(qids)), score.shape[1])
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(keys.ravel()), pa.array(score.ravel())], ["query_id", "vec_id", "about"])

    def run(batches):
        held: dict[tuple, tuple] = {}
        size = 0
        for batch in batches:
            for r in range(batch.num_rows):
                cell, qids, ids = batch.column("cell")[r].as_py(), batch.column("qids")[r].values, batch.column("ids")[r].values
                queries = np.frombuffer(batch.column("numbers")[r].as_py()).reshape(len(qids), -1)
                codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint8).reshape(len(ids), -1)
                score, keys = model.value.scores(queries, cell, codes), np.broadcast_to(np.array(ids), (len(qids), len(ids)))
                key = (cell, str(qids[0]), str(qids[-1]), len(qids))
                if key in held:
                    score, keys = np.concatenate([held[key][1], score], 1), np.concatenate([held[key][2], keys], 1)
                    size -= held[key][1].size
                if score.shape[1] > rerank:
                    top = np.argpartition(-score, rerank - 1, axis=1)[:, :rerank]
                    score, keys = np.take_along_axis(score, top, 1), np.take_along_axis(keys, top, 1)
                # Values of their own: a slice would keep its whole batch.
                held[key] = pa.array(qids.to_pylist(), qids.type), score, np.array(keys)
                size += score.size
                if size >= HELD:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    return run


def nearest_by_codes(vectors: DataFrame, queries: DataFrame, k: int, model: Model | None, blocks: DataFrame | None = None, rerank: int = RERANK, probes: int | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: nearly the k vectors of the greatest cosine, with their exact scores.

    vectors: vec_id, v; queries: query_id, qv; ids are integers. model: from fit(); blocks: from index(), as they were
    written; made anew unless given. A query reads ``rerank`` vectors. Zero vectors score 0, null vectors are in no cell.
    """
    spark = vectors.sparkSession
    kinds = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"query_id {kinds[1]}, vec_id {kinds[0]}, score double, rank int")
    ship(spark)
    if blocks is None:
        with batches_of(spark, BLOCK):
            blocks = kept(index(vectors, model), "codes")
    shared = spark.sparkContext.broadcast(model)
    salts = blocks.groupBy("cell").agg(F.ceil(F.count("*") / TASK_BLOCKS).cast("int").alias("salts"))  # MOST_CELLS rows at most
    left = blocks.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod("block", F.col("salts")).cast("int")).drop("salts", "block")
    right = _packs(queries, shared, probes).join(F.broadcast(salts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "qids", "numbers")
    met = left.join(right, ["cell", "salt"]).select("cell", "ids", "codes", "qids", "numbers")
    found = met.mapInArrow(tidy(_candidates(shared, max(rerank, k))), f"query_id {kinds[1]}, vec_id {kinds[0]}, about double")
    # Written in batches of few rows, each of which holds a block and a pack.
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id"))).where(F.col("_r") <= max(rerank, k)).select("query_id", "vec_id")
    with batches_of(spark, PACK):
        best = kept(best, "best")
    exact = best.join(vectors.select("vec_id", "v"), "vec_id").join(queries.select("query_id", "qv"), "query_id").select("query_id", "vec_id", F.round(F.coalesce(cosine(F.col("v"), F.col("qv")), F.lit(0.0)), 6).alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
