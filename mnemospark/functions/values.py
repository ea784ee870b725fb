"""Columns of values as exports write them: times in several forms, durations, vectors as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a weekday's name before a time looks; Spark reads the time behind it.
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? "
FORMATS = ("yyyy-MM-dd HH:mm:ss Z", "MMM d HH:mm:ss Z yyyy", "d MMM yyyy HH:mm:ss Z")


def instant(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The time a text names: ISO with Z, an offset or none (then as the session's zone), one of the formats (a weekday
    before it is passed over), or seconds since 1970. Null for anything else."""
    said = F.trim(text)
    plain = F.regexp_replace(said, _WEEKDAY, "")
    seconds = F.when(said.rlike(r"^-?[0-9]{1,12}(?:\.[0-9]+)?$") & ~said.rlike("^[0-9]{4}$"), F.timestamp_seconds(said.try_cast("decimal(18,6)")))
    iso = F.when(said.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:$|[T ])"), said.try_cast("timestamp"))
    return F.coalesce(seconds, iso, *(F.try_to_timestamp(plain, F.lit(f)) for f in formats))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minutes to three places."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 60e6, 3)


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """A vector as 32-bit floats, little-endian, one after the other."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    """The vector that packed() made bytes of; null where these are no whole floats."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 for a zero vector, null for lengths that differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))
