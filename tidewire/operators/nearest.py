"""The nearest of very many vectors for each of very many others, exactly, through cells around pivots.

Pivots are some of the targets; each target lies in the cell of its nearest pivot, and a cell knows the widest angle between its pivot and what lies in it.  By
the triangle inequality of angles nothing in a cell is nearer than the angle to its pivot less that width.  So each query looks into the cell
of its nearest pivot first, and then only into cells that can still hold something as near as what it has found.

A task compares one block of queries with one block of targets of one cell; a cell that holds a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute known
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.staging import joined_by_count, staged

#: Queries and targets of a block.
BLOCK_ROWS = 2048
#: Angles are compared with this much to spare.
SLACK = 1e-6


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _units(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def _angles(v: np.ndarray, units: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(v) @ units.T, -1, 1))


def pivots_of(targets: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of about ``count`` targets, by a hash of their ids."""
    chosen = targets.orderBy(F.xxhash64(F.lit(3), "target"), "target").limit(count).select("v").toArrow().column("v").combine_chunks()
    flat = pa.compute.list_flatten(chosen).to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(flat.reshape(len(chosen), -1))


def _celled(targets: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``targets`` with their cell and their angle to its pivot."""
    share = targets.sparkSession.sparkContext.broadcast(pivots)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                angles = _angles(_rows(part.v), share.value)
                cell = angles.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(part)), cell])

    return targets.mapInPandas(run, f"target {dict(targets.dtypes)['target']}, v array<double>, cell int, angle double")


def _visits(queries: DataFrame, pivots: np.ndarray, widths: np.ndarray, first: bool) -> DataFrame:
    """(id, cell): the first cell of each query (id, v), or the others that may hold something within its angle ``found``."""
    share = queries.sparkSession.sparkContext.broadcast((pivots, widths))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, reach = share.value
        for part in parts:
            if not len(part):
                continue
            angles = _angles(_rows(part.v), units)
            angles[:, reach < 0] = np.inf  # cells without targets
            nearest = angles.argmin(1)
            if first:
                yield pd.DataFrame({"id": part.id, "cell": nearest.astype(np.int32)})
                continue
            may = angles - reach[None, :] <= part.found.to_numpy()[:, None] + SLACK
            may[np.arange(len(part)), nearest] = False
            i, cell = np.nonzero(may & np.isfinite(angles))
            yield pd.DataFrame({"id": part.id.to_numpy()[i], "cell": cell.astype(np.int32)})

    return queries.mapInPandas(run, f"id {dict(queries.dtypes)['id']}, cell int")


def _best(visits: DataFrame, queries: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, target, similarity): the best of each visit's cell, ties to the smaller target; refused ones are out."""
    count = visits.count()
    crowd = visits.groupBy("cell").agg(F.count("*").alias("n")).join(sizes, "cell")
    crowd = staged(crowd.select("cell", "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("xs"), F.ceil(F.col("targets") / BLOCK_ROWS).cast("int").alias("ys")), "crowd")
    part = lambda key, n: F.pmod(F.xxhash64(F.lit(9), key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cell", "x", "y"]
    asked = joined_by_count(visits, crowd, ["cell"], count).select("id", "cell", part("id", "xs").alias("x"), every("ys").alias("y")).join(queries.select("id", "v", "refused"), "id")
    held = targets.select("target", "v", "cell").join(F.broadcast(crowd), "cell").select("target", "v", "cell", every("xs").alias("x"), part("target", "ys").alias("y"))
    kinds = dict(queries.dtypes)["id"], dict(targets.dtypes)["target"]

    def compare(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "target", "similarity"]
        if not len(own) or not len(others):
            return pd.DataFrame(columns=columns)
        others = others.sort_values("target")
        names = others.target.to_numpy()
        place = {n: i for i, n in enumerate(names.tolist())}
        s = _units(_rows(own.v)) @ _units(_rows(others.v)).T
        for i, no in enumerate(own.refused):
            if no is not None:
                s[i, [place[x] for x in no if x in place]] = -np.inf
        best = s.argmax(1)
        top = s[np.arange(len(own)), best]
        good = np.isfinite(top)
        return pd.DataFrame({"id": own.id.to_numpy()[good], "target": names[best[good]], "similarity": top[good]})

    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, f"id {kinds[0]}, target {kinds[1]}, similarity double")
    return found.groupBy("id").agg(F.min_by(F.struct("target", "similarity"), F.struct(-F.col("similarity"), "target")).alias("m")).select("id", "m.*")


def nearest_by_cells(queries: DataFrame, targets: DataFrame, pivots: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(id, target, similarity) of the nearest target of each query (id, v, refused array), and how many pairs were compared of how many.

    ``targets``: (target, v).  Zero vectors on either side, and queries that are refused everywhere, give no row.  By default there are as many pivots as the root of
    the number of targets, so the pivots that every task holds grow with the root only.
    """
    nonzero = F.exists("v", lambda x: x != 0)
    queries = staged(queries.where(nonzero).select("id", F.col("v").cast("array<double>").alias("v"), "refused"), "queries")
    targets = staged(targets.where(nonzero).select("target", F.col("v").cast("array<double>").alias("v")), "targets")
    asked, count = queries.count(), targets.count()
    if not asked or not count:
        empty = queries.select("id").limit(0).join(targets.select("target").limit(0)).withColumn("similarity", F.lit(0.0))
        return empty, {"compared": 0, "pairs": 0}
    units = pivots_of(targets, pivots or int(np.ceil(np.sqrt(count))))
    targets = staged(_celled(targets, units), "cells")
    cells = targets.groupBy("cell").agg(F.max("angle").alias("width"), F.count("*").alias("targets")).collect()  # one row a pivot
    widths, held = np.full(len(units), -1.0), np.zeros(len(units), np.int64)
    for r in cells:
        widths[r["cell"]], held[r["cell"]] = r["width"], r["targets"]
    sizes = queries.sparkSession.createDataFrame([(r["cell"], r["targets"]) for r in cells], "cell int, targets long")
    first = staged(_visits(queries.select("id", "v"), units, widths, True), "visits")
    best = staged(_best(first, queries, targets, sizes), "first")
    angle = F.coalesce(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("similarity")))), F.lit(4.0))
    seen = queries.join(best.select("id", "similarity"), "id", "left").select("id", "v", angle.alias("found"))
    more = staged(_visits(seen, units, widths, False), "visits")
    rest = staged(_best(more, queries, targets, sizes), "rest")
    both = best.union(rest).groupBy("id").agg(F.min_by(F.struct("target", "similarity"), F.struct(-F.col("similarity"), "target")).alias("m")).select("id", "m.*")
    visits = first.union(more).groupBy("cell").count().collect()  # one row a pivot
    return both, {"compared": sum(int(held[r["cell"]]) * r["count"] for r in visits), "pairs": asked * count}
