"""Toxicity: non-negative positive-unlabelled learning on hashed words and word beginnings.

Confirmed toxic texts are the positives; all other rows that may be learned from, labelled or not, are unlabelled
text. The loss is the non-negative estimator: pi * R+(1) + max(0, Ru(-1) - pi * R+(-1)), where pi, the share of toxic
texts among the unlabelled, corrects what these rows hold. Where the second part falls below zero, the step goes the
other way. Unless pi is given, it is estimated from the texts themselves: a first model, fitted on one half, scores the
other half; pi is the ratio of the share of unlabelled texts above a threshold to the share of positives above it, at the
threshold where that ratio, either share with its standard error, is least. No negative label is needed.

A text's features are its distinct words and their beginnings of 3 to 5 characters, each counted once, so neither
length nor order matters. Null and empty texts have no features and get the score of the intercept. Repeated rows get
the same score. Without positives, or without texts, all scores are 0. Rows without an id are scored but never learned
from; of several rows of one id one is learned from.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark import workers

from .common import map_batches

#: Rows to fit on, at most, of either kind: those of the smallest hashes of their ids.
FIT_ROWS = 4_000
FEATURES = 1 << 18
BEGINNINGS = (3, 4, 5)
EPOCHS, RATE, DECAY = 300, 0.1, 1e-5
#: The score of an even chance: callers act at 0.7.
EVEN = 0.7
#: A beginning or word that is in fewer positives is not used.
LEAST = 3

_WORD = re.compile(r"[^\W\d_]+")
_CACHE: dict[str, tuple[int, ...]] = workers.memory("toxicity")


def _of_word(word: str) -> tuple[int, ...]:
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) > 500_000:
            _CACHE.clear()
        parts = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
        found = _CACHE[word] = tuple(zlib.crc32(p.encode()) % FEATURES for p in parts)
    return found


def features(text: str | None) -> set[int]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in _of_word(w)}


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch steps on the non-negative risk with the logistic loss."""
    df = np.bincount(np.concatenate(positive), minlength=FEATURES)
    seen = np.bincount(np.concatenate(unlabelled), minlength=FEATURES)
    # A feature that more unlabelled texts have than there are toxic ones is no sign of these.
    used = np.flatnonzero((df >= LEAST) & (seen <= prior * len(unlabelled)))
    index = np.full(FEATURES, -1)
    index[used] = np.arange(len(used))
    rows = positive + unlabelled
    columns = [c[c >= 0] for c in (index[r] for r in rows)]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    column = np.concatenate(columns)
    # How far positives have a feature more often than unlabelled text; the rest says little.
    often = df[used] / len(positive)
    scale = np.sqrt(np.maximum(often - seen[used] / len(unlabelled), 0))
    n_pos, n_un = len(positive), len(unlabelled)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, (w * scale)[column], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        g = np.zeros(len(rows))
        inner = loss_neg[n_pos:].mean() - prior * loss_neg[:n_pos].mean()
        g[:n_pos] = prior * (p[:n_pos] - 1) / n_pos
        if inner >= 0:
            g[n_pos:] += p[n_pos:] / n_un
            g[:n_pos] -= prior * p[:n_pos] / n_pos
        else:
            g[n_pos:] -= p[n_pos:] / n_un
            g[:n_pos] = prior * p[:n_pos] / n_pos
        gw, gb = np.bincount(column, g[row], len(used)) * scale + DECAY * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= fix * m / (np.sqrt(v) + 1e-8)
        b -= fix * mb / (np.sqrt(vb) + 1e-8)
    out = np.zeros(FEATURES, np.float32)
    out[used] = w * scale
    return out, float(b)


#: The share that the first model takes for granted, and the bounds of the estimate.
GUESS, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.01, 0.5


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The share of positives among the unlabelled, from the scores of a model that was fitted on the other half."""
    if min(len(positive), len(unlabelled)) < 8:
        return GUESS
    weights, bias = fit(positive[::2], unlabelled[::2], GUESS)
    p, u = (np.sort([weights[r].sum(dtype=np.float64) + bias for r in rows[1::2]]) for rows in (positive, unlabelled))
    cuts = p[: len(p) - len(p) // 4]  # beyond, shares are of too few positives
    above = lambda x: 1 - np.searchsorted(x, cuts, "left") / len(x)
    error = lambda q, n: np.sqrt(np.maximum(q * (1 - q), 1 / n) / n)
    qp, qu = above(p), above(u)
    bound = (qu + error(qu, len(u))) / np.maximum(qp - error(qp, len(p)), 1e-3)
    best = bound.argmin()
    return float(np.clip(qu[best] / qp[best], LEAST_PRIOR, MOST_PRIOR))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = FIT_ROWS, prior: float | None = None) -> tuple[np.ndarray, float] | None:
    """A model from at most ``most`` positives and ``most`` others of the given rows; None without positives.

    prior: the share of toxic texts among the others; estimated unless given.
    """
    own = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(toxic).alias("toxic"))
    order = F.xxhash64(doc_id)
    keys = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().join(own, doc_id, "left")
    # Ids first, texts of the chosen ids after; both lists are bounded by `most`.
    chosen = [[r[0] for r in keys.where((F.coalesce("toxic", F.lit(0)) == 1) == p).orderBy(order, doc_id).limit(most).select(doc_id).collect()] for p in (True, False)]
    if not chosen[0] or not chosen[1]:
        return None
    # Whether a text is a positive hangs on its id alone, so only the bounded list of chosen ids meets the texts.
    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(i, p) for p, ids in zip((True, False), chosen, strict=True) for i in sorted(set(ids))], f"{doc_id} {kind}, p boolean")

    def run(batches):
        for batch in batches:
            values = [np.array(sorted(features(t)), np.int32).tobytes() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column("p"), pa.array(values, pa.binary())], [doc_id, "p", "f"])

    found = map_batches(docs.select(doc_id, text).join(F.broadcast(wanted), doc_id), run, f"{doc_id} {kind}, p boolean, f binary", "toxicity")
    # Rows of one id may be many; one of them is learned from.
    found = sorted(found.groupBy(doc_id, "p").agg(F.min("f").alias("f")).collect(), key=lambda r: zlib.crc32(str(r[0]).encode()))
    rows = lambda p: [np.frombuffer(r.f, np.int32) for r in found if r.p == p]
    return fit(rows(True), rows(False), estimate_prior(rows(True), rows(False)) if prior is None else prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", even: float = EVEN) -> DataFrame:
    """Replaces the text by ``score double`` from 0 to 1; even: the score of a text that is toxic with a chance of a half."""
    shift = float(np.log(even / (1 - even)))
    weights, bias = model or (np.zeros(FEATURES, np.float32), -np.inf)
    own = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES numbers
    keep = [c for c in docs.columns if c not in (text, "score")]
    memo: dict = {}

    def run(batches):
        w = own.value
        known = memo

        def weight(word: str) -> tuple:
            if len(known) > 400_000:
                known.clear()
            found = known[word] = tuple(f for f in _of_word(word) if w[f])
            return found

        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                hits: set[int] = set()
                for word in set(_WORD.findall((t or "").lower())):
                    found = known.get(word)
                    if found is None:
                        found = weight(word)
                    if found:
                        hits.update(found)
                out.append(0.0 if bias == -np.inf else float(1 / (1 + np.exp(-np.clip(w[sorted(hits)].sum(dtype=np.float64) + bias + shift, -700, 700)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "score"])

    return map_batches(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "score double"]), "toxicity")
