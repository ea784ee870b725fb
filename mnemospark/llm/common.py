"""Shared helpers: reading tables, batch sizes, tables in the shared folder and 64-bit hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import scratch, ship
from mnemospark.workers import tidy

#: Rows in one Arrow batch: whole texts and packed messages travel in it, so it is far below Spark's 10,000.
BATCH_ROWS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, memory: str = "") -> DataFrame:
    """``mapInArrow`` with batches small enough for whole texts; workers give memory back when a task ends.

    memory: the name of what fn remembers between tasks.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(tidy(fn, memory), schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table to the shared folder and reads it back.

    Unlike a local checkpoint it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEYS: dict[int, list[int]] = {}


def deal(messages: DataFrame, parts: int) -> DataFrame:
    """Rows of each ``key``, 0 to parts - 1, to a partition of their own."""
    if parts not in _KEYS:
        # A number for each partition that Spark's hash puts there.
        tried = messages.sparkSession.range(40 * parts).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
        found = {r.p: r.i for r in tried.groupBy("p").agg(F.min("i").alias("i")).collect()}
        _KEYS[parts] = [found.get(p, p) for p in range(parts)]
    return messages.repartition(parts, F.get(F.lit(_KEYS[parts]), F.col("key")))


# ---- hashing -------------------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: An odd 64-bit number for each byte value.
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more entry at the end).

    space: for each byte value, whether it ends a word. Words never cross rows.
    """
    word = ~space[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: its eight-byte words, one after the other, each mixed in by a bijection."""
    value = mix64((ends - starts).astype(np.uint64) * _GOLD + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the word that starts at each byte
    left, at, open_ = ends - starts, starts, np.arange(len(starts))
    while len(open_):
        keep = left > 0
        if not keep.all():
            left, at, open_ = left[keep], at[keep], open_[keep]
        inside = words[at] & (_FULL >> (np.maximum(8 - left, 0) * 8).astype(np.uint64))
        value[open_] = mix64(value[open_] ^ inside * _GOLD)
        left, at = left - 8, at + 8
    return value


_FULL = np.uint64(2**64 - 1)


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit rolling hash of each k-byte window, by doubling."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    part, size, factor = BYTE_HASH[data], 1, int(_GOLD)
    out, have = None, 0
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                n = len(part) - have
                out, have = out[:n] * np.uint64(factor) + part[have:], have + size
        if size * 2 > k:
            return mix64(out)
        n = len(part) - size
        part = part[:n] * np.uint64(factor) + part[size:]
        size, factor = size * 2, factor * factor % 2**64


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold about so many bytes of the column (or elements of a list column) at most."""
    values = batch.column(column)
    count = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = np.cumsum(np.array(pc.fill_null(count(values), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, anew in batches of about so many bytes of the column at most."""
    held, size = [], 0
    for batch in (part for whole in batches for part in by_bytes(whole, column, most)):
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most:
            yield joined(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each stretch, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def merge_schema(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], [*keep, *more])
