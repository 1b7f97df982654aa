"""Annotation windows as a streaming source: its offsets are quarter hours.

A publisher writes one archive every quarter of an hour and a listing that names the newest.  Which archives lie between two offsets is
arithmetic, so nothing is listed: up to ``windows`` missed archives are healed, oldest first, and after a longer absence only the newest is
read.  What is skipped then, and every archive that is missing or broken, is a row of its own, so a run can state it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewire.sources.feeds import ARCHIVE_BYTES, archive_slices

QUARTER = timedelta(minutes=15)
MOST = 8
STAMP = "%Y%m%d%H%M%S"
LISTING = "lastupdate.txt"
ENDING = ".gkg.csv.zip"
#: ``status``: a line of an archive, an archive that could not be read, or a number of windows passed over.
LINE, FAILED, SKIPPED = "line", "failed", "skipped"
SCHEMA = pa.schema([("window", pa.string()), ("status", pa.string()), ("value", pa.string())])


def at(stamp: str) -> datetime:
    if not re.fullmatch(r"\d{14}", stamp):
        raise ValueError(f"not a window stamp: {stamp}")
    return datetime.strptime(stamp, STAMP).replace(tzinfo=timezone.utc)


def planned(cursor: str | None, current: str, most: int = MOST) -> tuple[list[str], int]:
    """The windows to read after ``cursor`` up to ``current``, oldest first, and how many are passed over.

    Without a cursor there is no history to have a gap in; a cursor off the grid counts as the quarter before it.
    """
    now = at(current)
    if cursor is None:
        return [current], 0
    held = at(cursor)
    held -= timedelta(minutes=held.minute % 15, seconds=held.second)
    missed = round((now - held) / QUARTER) - 1
    if missed < 0:
        return [], 0
    if missed > most:
        return [current], missed
    return [*((held + k * QUARTER).strftime(STAMP) for k in range(1, missed + 1)), current], 0


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, which may be a URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def newest(folder: str) -> str:
    """The window that the listing names last."""
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path.rstrip('/')}/{LISTING}") as f:
        found = re.findall(rf"(\d{{14}}){re.escape(ENDING)}\s*$", f.read().decode("utf-8", "replace"), re.M)
    if not found or at(found[-1]).minute % 15 or at(found[-1]).second:
        raise ValueError("the listing names no window of the grid")
    return found[-1]


class Window(InputPartition):
    """One archive to read, or the statement of a gap before it."""

    def __init__(self, stamp: str, skipped: int = 0) -> None:
        super().__init__(stamp)
        self.stamp, self.skipped = stamp, skipped


class QuarterHourReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.most, self.cursor = options["folder"].rstrip("/"), int(options.get("windows", MOST)), options.get("cursor")
        self.last = ""

    def initialOffset(self) -> dict:
        return {"window": self.cursor or (at(newest(self.folder)) - QUARTER).strftime(STAMP)}

    def latestOffset(self) -> dict:
        self.last = max(self.last, newest(self.folder))  # a clock that is set back brings no window twice
        return {"window": self.last}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        stamps, skipped = planned(start["window"], end["window"], self.most)
        return [*([Window(stamps[0], skipped)] if skipped else []), *map(Window, stamps)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        def rows(status: str, values: list[str | None]) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([partition.stamp] * n), pa.array([status] * n), pa.array(values, pa.string())], schema=SCHEMA)

        if partition.skipped:
            yield rows(SKIPPED, [str(partition.skipped)])
            return
        fs, path = opened(f"{self.folder}/{partition.stamp}{ENDING}")
        info = fs.get_file_info(path)
        if info.type != pa.fs.FileType.File or info.size > ARCHIVE_BYTES:
            yield rows(FAILED, ["no such archive" if info.type != pa.fs.FileType.File else "archive out of bounds"])
            return
        with fs.open_input_file(path) as f:
            for failure, lines in archive_slices(f.read()):
                if failure:
                    yield rows(FAILED, [failure])
                elif lines != [None]:
                    yield rows(LINE, lines)

    def commit(self, end: dict) -> None:
        """Nothing to give back: the archives stay with their publisher."""


class QuarterHours(DataSource):
    """Options: ``folder`` with the archives and their listing; ``windows``, the most that are healed; ``cursor``, the last window read, for a first start."""

    @classmethod
    def name(cls) -> str:
        return "quarter_hours"

    def schema(self) -> str:
        return "window string, status string, value string"

    def streamReader(self, schema: object) -> QuarterHourReader:
        return QuarterHourReader(dict(self.options))


def quarter_hours(spark: SparkSession, folder: str, *, windows: int = MOST, cursor: str | None = None) -> DataFrame:
    """(window, status, value) of the windows as they come; ``feeds.gkg_rows`` reads the lines."""
    spark.dataSource.register(QuarterHours)
    reader = spark.readStream.format("quarter_hours").option("folder", folder).option("windows", str(windows))
    return (reader if cursor is None else reader.option("cursor", cursor)).load()


def window_runs(rows: DataFrame) -> DataFrame:
    """(window, lines, failure, skipped) of each window in a batch, for the run ledger and the cursor."""
    return rows.groupBy("window").agg(
        F.count_if(F.col("status") == LINE).alias("lines"), F.min(F.when(F.col("status") == FAILED, F.col("value"))).alias("failure"),
        F.coalesce(F.max(F.when(F.col("status") == SKIPPED, F.col("value").cast("int"))), F.lit(0)).alias("skipped"),
    )
