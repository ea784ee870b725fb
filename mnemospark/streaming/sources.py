"""Sources that are asked again and again, as streams: pages behind a cursor, and trees of files that grow in place.

``landed_pages`` reads what a paged service gave, landed as one folder for each time it was asked, its pages (JSON objects)
sorted by name from the newest rows to the oldest. The offset is the folder and the newest time in it. A batch takes the
pages from the first one up to where a whole page is strictly older than the cursor before, and of these the rows at or
after it: rows that share the cursor's own time may stand on either side of it, so they come again, and the sink must
take them as known. A stream that starts from its checkpoint reads this boundary again and nothing older. Pages are
read where Spark reads them, some a task; the driver opens one for the offset and a few to find the boundary.

``listed_files`` lists a tree as path, size and modified: each folder below the top is a partition. By (path, size, time) a
sink finds what grew, moved in or changed, also where names stay (a file stream would not); with ``margin_hours`` only
files changed since so long before the last listing are passed on.
"""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mnemospark.operators.store import Store
from mnemospark.operators.upkeep import Archive
from mnemospark.session import ship


def _files(path: str):
    """A file system and the path in it: of any store that Arrow knows, or local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _below(path: str, deep: bool) -> list:
    from pyarrow import fs

    files, place = _files(path)
    return sorted(files.get_file_info(fs.FileSelector(place, recursive=deep, allow_not_found=True)), key=lambda i: i.path)


# ---- pages ---------------------------------------------------------------------------------------


#: Pages that one task reads.
PAGES_PER_TASK = 64


@dataclass
class Pages(InputPartition):
    paths: list[str]
    low: str


class _Pages:
    def __init__(self, options: dict):
        self.path, self.rows, self.time, self.key = options["path"], options.get("rows", "rows"), options.get("time", "createdAt"), options.get("key", "id")

    def folders(self) -> list[str]:
        return [posixpath.basename(i.path) for i in _below(self.path, False) if not i.is_file and not posixpath.basename(i.path).startswith((".", "_"))]

    def pages(self, folder: str) -> list[str]:
        return [i.path for i in _below(f"{self.path}/{folder}", True) if i.is_file and not posixpath.basename(i.path).startswith((".", "_"))]

    def load(self, page: str) -> list[dict]:
        files, _ = _files(self.path)
        with files.open_input_stream(page) as f:
            return json.loads(f.read()).get(self.rows) or []

    def newest(self, rows: list[dict]) -> str:
        return max((str(r.get(self.time) or "") for r in rows), default="")

    def dealt(self, pages: list[str], low: str) -> list[Pages]:
        return [Pages(pages[i : i + PAGES_PER_TASK], low) for i in range(0, len(pages), PAGES_PER_TASK)]

    def read(self, part: Pages) -> Iterator[tuple]:
        for row in (row for path in part.paths for row in self.load(path)):
            at = row.get(self.time)
            if at is None or part.low <= str(at):
                yield (str(row.get(self.key)), None if at is None else str(at), json.dumps(row, ensure_ascii=False))


class _PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"folder": "", "cursor": ""}

    def latestOffset(self) -> dict:
        folders = self.folders()
        for page in self.pages(folders[-1])[:1] if folders else []:
            return {"folder": folders[-1], "cursor": self.newest(self.load(page))}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        pages = self.pages(end["folder"]) if end["folder"] else []
        # Pages go from new to old: the first one that is strictly older than the cursor is found by halving.
        low, high = 0, len(pages)
        while low < high and start["cursor"]:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.newest(self.load(pages[mid])) >= start["cursor"] else (low, mid)
        return self.dealt(pages[: high if start["cursor"] else None], start["cursor"])


class _PageSweep(_Pages, DataSourceReader):
    def partitions(self) -> list[Pages]:
        folders = self.folders()
        return self.dealt(self.pages(folders[-1]), "") if folders else []


class PageFeed(DataSource):
    """Options: path, rows (the field that holds a page's rows), time (of a row, as text that sorts), key."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "id string, time string, row string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _PageSweep(dict(self.options))


# ---- files ---------------------------------------------------------------------------------------


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool
    since: int


class _FileStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.end, self.margin = options["path"], options.get("suffix", ""), options.get("margin_hours")

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        since = 0 if self.margin is None or not start["until"] else start["until"] - int(float(self.margin) * 3_600_000)
        return [Folder(self.path, False, since), *(Folder(i.path, True, since) for i in _below(self.path, False) if not i.is_file)]

    def read(self, part: Folder) -> Iterator[tuple]:
        for info in _below(part.path, part.deep):
            if info.is_file and info.path.endswith(self.end) and info.mtime_ns // 1_000_000 >= part.since:
                yield (info.path, info.size, info.mtime_ns // 1000)


class FileListing(DataSource):
    """Options: path, suffix of the names, margin_hours."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return "path string, size long, modified_us long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FileStream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PageFeed)
    spark.dataSource.register(FileListing)


# ---- into tables ---------------------------------------------------------------------------------


def _run(feed: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    feed.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def sync_pages(archive: Archive, pages: dict, checkpoint: str, record, full: bool = False) -> dict[str, int]:
    """Takes what is new behind the cursor into the archive, and says what became of the rows.

    pages: options of landed_pages; record: from a DataFrame of id, time, row to the archive's records. full: also takes
    the whole listing, and items of its source that it no longer has go. A run that fails leaves the cursor where it was;
    rows that come again are known by their content and skipped.
    """
    spark, counts = archive.store.spark, {"rows": 0, "inserted": 0, "updated": 0, "skipped": 0, "pruned": 0}
    register(spark)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            counts["rows"] += rows.count()
            for name, n in archive.sync(record(rows))[1].items():
                counts[name] += n
        finally:
            rows.unpersist()

    _run(spark.readStream.format("landed_pages").options(**pages).load(), checkpoint, write)
    if full:
        listed = record(spark.read.format("landed_pages").options(**pages).load())
        sources = [r[0] for r in listed.select("source").distinct().limit(2).collect()]
        if len(sources) > 1:
            raise ValueError("a full sweep is of one source")
        if sources:
            for name, n in archive.sync(listed, listed, sources[0])[1].items():
                counts[name] += n
    return counts


def sync_files(store: Store, listing: dict, checkpoint: str, table: str = "files") -> DataFrame:
    """path, action (insert or update) of the files that are new or changed since the last run, by size and time.

    Their states are kept in a table of the store, so a listing that comes again changes nothing.
    """
    from pyspark.sql.types import StructType

    spark, found = store.spark, []
    register(spark)

    def write(batch: DataFrame, number: int) -> None:
        change = store.change()
        change.create(table, StructType.fromDDL("path string, size long, modified_us long, state string"), "path", 64)
        actions = change.put(table, batch.withColumn("state", F.concat_ws(":", "size", "modified_us")), "state")
        change.commit()
        found.append(actions.where("action <> 'skip'"))

    _run(spark.readStream.format("listed_files").options(**listing).load(), checkpoint, write)
    every = spark.createDataFrame([], "path string, action string")
    for one in found:
        every = every.unionByName(one)
    return every
