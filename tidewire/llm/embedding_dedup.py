"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine check, connected components.

Vectors meet only under equal labels.  Equal vectors are folded into one class first.  Each table
gives a class a code of ``bits`` signs; classes with one code in a table form a bucket.  The
bits grow with the logarithm of the largest label and the number of tables follows from
the recall wanted at the threshold, so chance collisions and recall stay the same at every size.  Buckets of
one class are dropped by their counts before any vector moves; large buckets are compared in pairs of bounded blocks, so no task holds a
whole one, and no pair leaves a task: what leaves is, per class and block, the number of links, and a spanning set of
links for the components.  A pair that meets in several tables counts in the first one only.

Results for odd input: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
nothing (n_links 0, a component of their own).  Vectors of unequal length do not link.  Repeated rows
are links like any others.  A null vec_id links with nothing and is its own component.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.components import components
from tidewire.llm.shared import block_pairs, by_block, runs, slices
from tidewire.staging import joined_by_count, staged

LEAST_BITS = 16
RECALL = 0.995
BLOCK = 512


def table_count(threshold: float, bits: int, recall: float) -> int:
    """Tables needed for two vectors at the threshold to share a code in one of them with the given probability."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def hyperplanes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def codes_of(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits * tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(2)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision; very large and very small ones are scaled first."""
    values = np.array(column.to_pylist(), np.float64)
    values /= np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def local_components(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(block: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class ids of a block, links of each counted here for the first time, and each one's least partner in the block."""
    low, high, part = (block.column(c).to_numpy() for c in ("low", "high", "part"))
    rows, across = matrix(block.column("vector")), low[0] != high[0]
    ids, copies, table = block.column("id").to_numpy(), block.column("copies").to_numpy(), int(block.column("table")[0].as_py())
    codes, label = np.array(block.column("codes").to_pylist(), np.int64), block.column("label").to_numpy()
    linked = (rows @ rows.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    if across:
        linked &= part[:, None] != part[None, :]
    first = linked.copy()
    for t in range(table):
        first &= codes[:, t][:, None] != codes[:, t][None, :]
    least = local_components(linked)
    return ids, first @ copies, ids[least]


def find_links(vectors: DataFrame, threshold: float = 0.93, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", recall: float = RECALL, seed: int = 71) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links are the pairs found with cosine >= threshold."""
    v = F.col("vector")
    number = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, number) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<double>").alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [hashlib.blake2b((np.array(x) + 0.0).tobytes(), digest_size=16).digest() for x in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.binary())], ["id", "label", "vector", "digest"])

    base = staged(rows.where("sound").drop("sound").mapInArrow(digested, "id long, label long, vector array<double>, digest binary"), "vectors")
    folded = base.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    folded = staged(folded, "classes")
    largest = folded.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(LEAST_BITS, math.ceil(math.log2(largest)))
    tables = table_count(threshold, bits, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lists = b.column("vector").to_pylist()
            found: list = [None] * len(lists)
            for dim in {len(x) for x in lists}:
                own = [i for i, x in enumerate(lists) if len(x) == dim]
                for i, codes in zip(own, codes_of(np.array([lists[i] for i in own]), bits, tables, seed).tolist(), strict=True):
                    found[i] = codes
            sizes = pa.array([len(x) for x in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), sizes, pa.array(found, pa.list_(pa.int64()))], ["id", "label", "dim", "codes"])

    n_classes, total = folded.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    classes = folded.select("id", "label", "copies", "vector")
    codes = staged(folded.select("id", "label", "vector").mapInArrow(coded, "id long, label long, dim int, codes array<long>"), "codes")
    places = codes.select("id", "label", "dim", F.posexplode("codes").alias("table", "code"))
    places = places.select("id", "table", F.xxhash64("label", "dim", "table", "code").alias("bucket"))
    full = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    in_bucket = joined_by_count(places, staged(full, "buckets"), ["bucket"], n_classes * tables)
    met = block_pairs(in_bucket, "bucket", "id", "n", BLOCK)
    loaded = met.select("block", "id", "table", "part", "low", "high").join(classes.join(codes.select("id", "codes"), "id"), "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches):
            if block.num_rows < 2:
                continue
            ids, links, partner = _compare(block, threshold)
            told = (links > 0) | (ids != partner)
            if told.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (ids, links, partner)], ["id", "links", "partner"])

    columns = loaded.select("block", "id", "label", "copies", "vector", "codes", "table", "part", "low", "high")
    found = staged(by_block(columns).mapInArrow(compared, "id long, links long, partner long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("partner").alias("b")))
    whole = classes.select("id", "copies").join(links, "id", "left").join(reached, "id", "left")
    whole = whole.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_class = staged(folded.select("label", "digest", "id", "copies").join(whole, "id").drop("id"), "found")
    linked = joined_by_count(base.select("id", "label", "digest"), of_class, ["label", "digest"], total, n="copies").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
