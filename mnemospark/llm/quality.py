"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight for each hashed feature; ordered thresholds cut the score: P(grade > k) is the logistic
function of (score - threshold k). From these come the expected grade and the tail probability that a document is
selected by. Features are hashed byte 4-grams of the whole text, as shares of the text, and how often one of its 4-grams
repeats on average.

Null and empty texts have no features and so the score 0; repeated rows get the same values. Rows without an id are scored
but never learned from; of several rows of one id one is learned from. Columns pass through, but for those named like an
output column. With fewer than two grades among the labels nothing can be told apart: the expected grade is that grade (or null), the tail 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_batches, text_bytes

#: Labelled rows to fit on, at most: those of the smallest hashes of their ids.
FIT_ROWS = 2_000
FEATURES = 1 << 14
GRAM = 4
#: Steps of the mean number of repeats, two for each doubling, and their weight beside the shares.
REPEATS, REPEAT_SHARE = 24, 0.5
EPOCHS, RATE, DECAY = 300, 0.5, 1e-5
#: Features of fewer texts are not fitted.
LEAST = 3


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each byte 4-gram, and where each row's start (one more entry at the end)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    value = np.zeros(n, np.uint32)
    for i in range(GRAM):
        value = value << np.uint32(8) | data[i : i + n]
    value = (value * np.uint32(2654435761)) >> np.uint32(32 - 14)
    lengths = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, offsets[:-1], lengths > 0)
    np.add.at(inside, offsets[:-1] + lengths, -(lengths > 0).astype(np.int64))
    return value[np.cumsum(inside)[:n] > 0].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def repeats(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The feature for the mean number of repeats of each row's 4-grams."""
    distinct = np.array([np.count_nonzero(np.bincount(value[a:b], minlength=FEATURES)) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    return FEATURES + np.minimum(2 * np.log2(np.maximum(np.diff(starts), 1) / np.maximum(distinct, 1)), REPEATS - 1).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. rows: features and their shares; grades: 0 .. n_grades - 1."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])
    column = np.concatenate([f for f, _ in rows])
    share = np.concatenate([s for _, s in rows]) * np.float32(100)
    often = np.bincount(column)[column] >= LEAST
    row, column, share = row[often], column[often], share[often]
    above = (grades[:, None] > np.arange(n_grades - 1)).astype(float)
    rate = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    start = -np.log(rate / (1 - rate))
    # Thresholds in order: the first, and the logarithms of the steps.
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(FEATURES + REPEATS)
    gw2, gs2 = np.full(len(w), 1e-8), np.full(len(steps), 1e-8)
    for _ in range(EPOCHS):
        cut = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        z = np.bincount(row, w[column] * share, len(rows))
        error = (1 / (1 + np.exp(-np.clip(z[:, None] - cut, -30, 30))) - above) / len(rows)
        gw = np.bincount(column, (error.sum(1))[row] * share, len(w)) + DECAY * w
        gc = -error.sum(0)
        gs = np.cumsum(gc[::-1])[::-1] * np.concatenate([[1.0], np.exp(steps[1:])])
        gw2 += gw * gw
        gs2 += gs * gs
        w -= RATE * gw / np.sqrt(gw2) * 0.1
        steps -= RATE * gs / np.sqrt(gs2) * 0.1
    return w.astype(np.float32) * 100, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "quality", rows: int = FIT_ROWS) -> dict:
    """A model from at most ``rows`` graded texts: its grades, weights and thresholds."""
    kind = docs.schema[doc_id].dataType.simpleString()
    own = labels.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(doc_id).agg(F.min(grade).alias("grade"))
    known = own.join(docs.select(doc_id).distinct(), doc_id, "left_semi").orderBy(F.xxhash64(doc_id), doc_id).limit(rows).collect()
    grades = sorted({r.grade for r in known})
    if len(grades) < 2:
        return {"grades": grades, "weights": np.zeros(FEATURES + REPEATS, np.float32), "cuts": np.zeros(0)}
    wanted = docs.sparkSession.createDataFrame([(r[0], r.grade) for r in known], f"{doc_id} {kind}, grade {own.schema['grade'].dataType.simpleString()}")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            value, starts = grams(data, offsets)
            f, s = [], []
            for a, b, r in zip(starts[:-1], starts[1:], repeats(value, starts), strict=True):
                u, c = np.unique(value[a:b], return_counts=True)
                f.append(np.append(u, r).astype(np.int32).tobytes())
                s.append(np.append(c / max(b - a, 1), REPEAT_SHARE).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column("grade"), pa.array(f, pa.binary()), pa.array(s, pa.binary())], [doc_id, "grade", "f", "s"])

    found = map_batches(docs.select(doc_id, text).join(F.broadcast(wanted), doc_id), run, f"{doc_id} {kind}, grade {own.schema['grade'].dataType.simpleString()}, f binary, s binary")
    # Rows of one id may be many; one of them is learned from.
    found = sorted(found.groupBy(doc_id, "grade").agg(F.min(F.struct("f", "s")).alias("r")).collect(), key=lambda r: r[0])
    weights, cuts = fit([(np.frombuffer(r.r.f, np.int32), np.frombuffer(r.r.s, np.float32)) for r in found], np.array([grades.index(r.grade) for r in found]), len(grades))
    return {"grades": grades, "weights": weights, "cuts": cuts}


def score(docs: DataFrame, model: dict, text: str = "text", target: int | None = None) -> DataFrame:
    """Adds ``expected_grade double`` and ``tail double``: the probability of a grade of ``target`` or more.

    target: the highest grade unless given.
    """
    grades, cuts = np.array(model["grades"], float), model["cuts"]
    weights = docs.sparkSession.sparkContext.broadcast(model["weights"])  # a fixed number of weights
    which = len(cuts) - 1 if target is None else int(np.searchsorted(grades, target)) - 1
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail")]

    def run(batches):
        w = weights.value.astype(np.float64)
        for batch in (part for whole in batches for part in by_bytes(whole, text)):
            data, offsets = text_bytes(batch.column(text))
            value, starts = grams(data, offsets)
            sums = np.concatenate([[0.0], np.cumsum(w[value])])
            z = (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(np.diff(starts), 1) + REPEAT_SHARE * w[repeats(value, starts)]
            above = 1 / (1 + np.exp(-np.clip(np.round(z, 9)[:, None] - cuts, -30, 30)))
            expected = grades[0] + (above * np.diff(grades)).sum(1) if len(grades) else np.full(len(z), np.nan)
            tail = above[:, which] if len(cuts) and which >= 0 else np.ones(len(z))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(expected, pa.float64(), from_pandas=True), pa.array(tail, pa.float64())], [*keep, "expected_grade", "tail"])

    return map_batches(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "expected_grade double, tail double"]))
