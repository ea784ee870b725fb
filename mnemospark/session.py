"""Sessions, and how executors get this package."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: By application: the folder of a local session without a shared one, and the scratch tables written.
_OWN: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}
#: Of each thread, the scratch tables written since it entered passing().
_PASSING = threading.local()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "mnemospark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("mnemospark", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; elsewhere that is an error, as executors would
    not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="mnemospark-")
        base = _OWN[app]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear_scratch() deletes what stands there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := getattr(_PASSING, "paths", None)) is not None:
        own.append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a scratch table: for what is read several times and is dear to make."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession):
    """Scratch tables that this thread writes inside are deleted at its end: for work whose results stand elsewhere then."""
    before, _PASSING.paths = getattr(_PASSING, "paths", None), []
    try:
        yield
    finally:
        paths, _PASSING.paths = _PASSING.paths, before
        _delete(spark, paths)
        held = _TABLES.get(spark.sparkContext.applicationId, [])
        held[:] = [path for path in held if path not in set(paths)]
        # Shuffle files go once the driver's collector has seen that nothing reads them any more.
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> int:
    """Deletes all scratch tables of this application and says how many; results that still read them end with it."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("mnemospark")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
