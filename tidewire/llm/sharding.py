"""Reproducible sharding by a Feistel permutation with cycle walking.

Rows get global numbers 0..N-1 in an order that depends on their content alone (a hash bucket of key and text, then
key, checksum and size), without a total sort: each bucket numbers its own rows after an offset, the number of
rows in the buckets before it.  A keyed Feistel network permutes the numbers; the few images outside 0..N-1
walk on along their cycle until they fall inside.  Image ``p`` lies in shard ``p mod shards`` at slot
``p div shards``: shard sizes differ by one row at most, slots have no gaps, and both are computed from the row number
by :func:`place` and back by :func:`unplace`, with no lookup.

Results for odd input: a null text has size 16 and checksum 0; null keys count as a key of their own; repeated rows
each get a place (identical rows are interchangeable); an empty table gives an empty table; other columns are not read.
The law is ``rows``, so rows with equal texts are spread like any others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.shared import text_of
from tidewire.staging import staged

ROUNDS = 6
OVERHEAD = 16
CHUNK = 10_000


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, as the round function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    """Bits of each half: the network permutes 2^(2 * bits) >= n numbers, less than 4 n of them."""
    return max(1, math.ceil(math.log2(max(n, 2)) / 2))


def _network(x: np.ndarray, bits: int, seed: int, rounds: range) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    forward = rounds.step > 0
    for r in rounds:
        key = (seed * 0x100000001B3 + r * 0x5851F42D4C957F2D + 1) % (1 << 64)
        if forward:
            left, right = right, left ^ (mix(right, key) & mask)
        else:
            left, right = right ^ (mix(left, key) & mask), left
    return left << shift | right


def _walk(numbers: np.ndarray, n: int, seed: int, rounds: range) -> np.ndarray:
    bits = half_bits(n)
    with np.errstate(over="ignore"):
        out = _network(numbers.astype(np.uint64), bits, seed, rounds)
        while (outside := np.flatnonzero(out >= np.uint64(n))).size:
            out[outside] = _network(out[outside], bits, seed, rounds)
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The image of each number in 0..n-1."""
    return _walk(numbers, n, seed, range(ROUNDS))


def unpermute(images: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _walk(images, n, seed, range(ROUNDS - 1, -1, -1))


def place(numbers: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    image = permute(np.asarray(numbers), n, seed)
    return image % shards, image // shards


def unplace(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number that lies at a shard's slot."""
    return unpermute(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def numbered(rows: DataFrame, order: list[str], into: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with global numbers 0..N-1 that follow from the rows' content, and N.

    About 4 sqrt(N) buckets: each holds sqrt(N) / 4 rows, and the table of offsets as many entries.  Identical rows
    are counted before the shuffle and unfolded after it in chunks of bounded size that are dealt anew, so copies of one row are
    neither a hot bucket nor one long array.
    """
    spark = rows.sparkSession
    folded = staged(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("copies")), "rows")
    n = folded.agg(F.sum("copies")).first()[0] or 0
    buckets = 1 << max(2, math.ceil(math.log2(max(n, 1)) / 2) + 2)
    dealt = folded.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("bucket").agg(F.sum("copies").alias("size")).collect()  # 4 sqrt(N) rows at most
    before, total = [], 0
    for bucket, size in sorted((r["bucket"], r["size"]) for r in counts):
        before.append((bucket, total))
        total += size
    offsets = F.broadcast(spark.createDataFrame(before, "bucket long, before long"))
    in_bucket = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier = F.coalesce(F.sum("copies").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = dealt.withColumn("earlier", earlier).join(offsets, "bucket").withColumn("first", F.col("before") + F.col("earlier"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK)))
    chunks = first.select(*order, "first", "copies", chunk.alias("chunk")).repartition("first", "chunk")
    start, end = F.col("first") + F.col("chunk") * CHUNK, F.col("first") + F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.select(*order, F.explode(F.sequence(start, end)).alias(into)), n


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240229, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, row_number, shard, slot, grown_shard) of every row.

    The text is read once and left in place; what is shuffled is a key, a size and a checksum a row.
    """
    content = text_of(docs, text)
    rows = docs.select(docs[key].alias("id"), (F.octet_length(content) + OVERHEAD).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    lines, n = numbered(rows, ["id", "text_crc32", "size"])

    @F.pandas_udf("shard int, slot long")
    def placed(numbers: pd.Series) -> pd.DataFrame:
        shard, slot = place(numbers.to_numpy(np.int64), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return lines.withColumn("at", placed("row_number")).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "row_number", "at.shard", "at.slot", F.lit(None).cast("int").alias("grown_shard")
    )
