"""Intermediate tables in the folder that the cluster shares, and joins that keep frequent keys apart.

Cut points of long plans are written as Parquet into the shared folder (``spark.checkpoint.dir``), which all executors
see, and read back: a lost executor costs only its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No more than so many keys are broadcast by :func:`joined_by_count`, and none with fewer rows than ``HOT_ROWS``.
HOT_KEYS = 10_000
HOT_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set a local session gets a temporary folder; on a cluster that is an error, as executors would
    write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a file that :func:`staged` writes where it is told how many rows to expect, and files it may always write.
FILE_ROWS, LEAST_FILES = 100_000, 16


def staged(df: DataFrame, name: str, rows: int | None = None, *, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    With a bound of its ``rows`` the last tasks are joined until each has about ``file_rows`` rows to write, so a small table is no thousands of files.
    All tables of an application lie in one folder, tidewire/<application id>, which may go when its results are written.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // file_rows)))
    path = f"{shared_dir(df.sparkSession)}/tidewire/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_limit(total: int) -> int:
    """Keys with more rows than this, of ``total``, are hot: there are at most ``HOT_KEYS`` of them at any size."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def joined_by_count(rows: DataFrame, found: DataFrame, keys: list[str], total: int, *, n: str = "n") -> DataFrame:
    """``rows`` joined on ``keys`` with ``found``, which has one row a key; ``n`` says how many of all ``total`` rows hold it.

    Hot keys meet by broadcast, so their rows stay where they are; the others meet by a shuffle.  Rows with a null key drop out.
    """
    hot = F.broadcast(found.where(F.col(n) > hot_limit(total)))
    rest = found.where(F.col(n) <= hot_limit(total))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return rows.join(hot, keys).unionByName(others)


def numbered(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """``rows`` with their place in the given order, from 0, staged.

    The rows are sorted in ranges; each range numbers its own rows after an offset, the number of rows in the ranges before it, so no task sees them all.
    """
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = staged(cut.select("*", F.spark_partition_id().alias("__range"), in_range.alias("__at")), "numbered")
    before, offsets = 0, []
    for r in sorted(cut.groupBy("__range").count().collect()):  # one row a range
        offsets.append((r["__range"], before))
        before += r["count"]
    first = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__range int, __before long"))
    return cut.join(first, "__range").withColumn(into, F.col("__before") + F.col("__at")).select(*rows.columns, into)
