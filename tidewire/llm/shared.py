"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SLICE = 256
#: Rows of a batch between Spark and its Python workers: texts are long, and a batch is held on both sides.
ROWS_PER_BATCH = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
HASHES = 1 << 63


def slots_for(wanted: int, total: int) -> int:
    """How many of ``HASHES`` hash values to take for about ``wanted`` of ``total`` rows: one at least, at any size."""
    return min(HASHES, max(1, math.ceil(wanted * HASHES / max(1, total))))


def sampled(key: Column | str, wanted: int, total: int, seed: int) -> Column:
    """Whether a row is one of about ``wanted`` of ``total``, by a hash of its key."""
    return F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit(HASHES - 1)) <= F.lit(slots_for(wanted, total) - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's reader alone; batches of the session get ``ROWS_PER_BATCH`` rows at most."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= ROWS_PER_BATCH:
        spark.conf.set(BATCH_ROWS, str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that a task holds few results at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by an integer key column, each as one table; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(start, end - start))
            if end < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def by_block(rows: DataFrame, key: str = "block") -> DataFrame:
    """Rows dealt out by a block key and sorted by it, for :func:`runs`."""
    return rows.repartition(key).sortWithinPartitions(key)


def block_pairs(members: DataFrame, key: str, member: str, count: str, size: int) -> DataFrame:
    """Members of groups, in blocks of about ``size``, so that every two members of a group meet in one block.

    A group of n rows is cut into ceil(n / size) parts by a hash of the member; a block holds the parts i <= j of a
    group.  Adds ``block`` long, ``part`` int (the member's own), ``low`` int and ``high`` int (i and j).  A group that fits makes one block.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(size))).cast("int")
    cut = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(7), member), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = met.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    return pairs.withColumn("block", F.xxhash64(key, "low", "high")).drop("parts", "other")
