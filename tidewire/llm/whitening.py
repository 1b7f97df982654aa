"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Entries become integers, so the rows to fit on are known exactly: each distinct vector once, n of them, with whole sums S.

1. **Blockwise TSQR.**  Each task stacks its centred rows x - S/n block by block under the triangle it has so far and keeps the new triangle R of
   the stack; triangles of ``FAN`` tasks are stacked alike, level by level, until one is left.  R has the singular values and right
   singular vectors of all centred rows, and no product of rows with rows is ever formed, so small deviations keep their digits.
2. **One-sided Jacobi.**  Plane rotations make the columns of R orthogonal, pair by pair, in rounds of disjoint pairs; the
   accumulated rotations are the components and the lengths of the columns, over sqrt(n), their standard deviations.

A task holds one block of rows and one triangle, the driver one triangle of dimension x dimension, whatever the number of vectors.
The vectors to fit on are written to the shared folder in a packed form, each once.

Results for odd input: a vector that is null, empty, or holds a null or non-finite entry is dropped; where vectors differ in length those of
the most frequent length (the longer one of equals) remain; an entry beyond a long counts as the nearest long; repeated rows count once in the fit and each get their result; a component
without deviation (constant columns, fewer vectors than components) has explained 0 and a null whitened value; a deviation beyond a long is null; equal
eigenvalues have components of their space, the same ones for all rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.staging import staged

SCALE = 256
FAN = 16
BLOCK_NUMBERS = 1 << 18
SWEEPS = 60
LONG = np.iinfo(np.int64)


@dataclass
class Whitening:
    """What a fit holds: ``components`` dimension x k, ``deviations`` one standard deviation a component, ``shares`` of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    shares: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over their standard deviations; NaN where there is no deviation."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, (x - self.mean) @ self.components / self.deviations, np.nan)


def blocks(dimension: int) -> int:
    """Rows of a block."""
    return max(dimension, BLOCK_NUMBERS // max(1, dimension), 1)


def usable(vector: Column | str) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad), F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of each entry as long; entries beyond a long count as the nearest one."""
    scaled = np.floor(SCALE * values.astype(np.float64))
    inside = np.abs(scaled) < 2.0**63
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, LONG.max, LONG.min))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x dimension of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _packed(rows: DataFrame) -> DataFrame:
    """(x binary) of each distinct whole vector: little-endian, in 16 bits a number where all fit, else in 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(matrix(b.column(0)))
            small = (np.abs(np.clip(x, -32768, 32767) - x) == 0).all(1)
            packed = [(r.astype("<i2") if s else r.astype("<i8")).tobytes() for r, s in zip(x, small.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["x"])

    return rows.mapInArrow(run, "x binary").distinct()


def _unpacked(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    values = batch.column(0).to_pylist()
    if all(len(v) == 2 * dimension for v in values):
        return np.frombuffer(b"".join(values), "<i2").reshape(-1, dimension).astype(np.int64)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dimension else "<i8").astype(np.int64) for v in values])


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of rows to fit on and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for b in batches:
            if b.num_rows:
                x = _unpacked(b, dimension)
                n += len(x)
                exact = np.abs(x.astype(np.float64)).max() * len(x) < 2**62
                sums = [a + int(s) for a, s in zip(sums, x.sum(0).tolist() if exact else x.astype(object).sum(0), strict=True)]
        yield pa.RecordBatch.from_pylist([{"at": i, "total": str(s)} for i, s in enumerate([*sums, n])], pa.schema([("at", pa.int32()), ("total", pa.string())]))

    told = fit.mapInArrow(run, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    found = {r["at"]: int(r["total"]) for r in told.collect()}  # one row a dimension
    return found.get(dimension, 0), [found.get(i, 0) for i in range(dimension)]


def stacked(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows below a triangle."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def _triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of all centred rows, by a tree of QR decompositions."""
    d = len(mean)
    schema = pa.schema([("task", pa.int64()), ("r", pa.list_(pa.float64()))])

    def told(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], schema=schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for at in range(0, b.num_rows, blocks(d)):
                r = stacked(r, _unpacked(b.slice(at, blocks(d)), d) - mean)
        yield from told(r)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for i in range(b.num_rows):
                r = stacked(r, b.column(1)[i].values.to_numpy().reshape(-1, d))
        yield from told(r)

    kind = "task long, r array<double>"
    level = staged(fit.mapInArrow(leaves, kind), "triangles")
    parts = level.count()
    while parts > 1:
        level = staged(level.coalesce(-(-parts // FAN)).mapInArrow(joined, kind), "triangles")
        parts = level.count()
    found = level.first()
    return np.array(found["r"]).reshape(-1, d)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of ``r``, falling.

    One-sided: in each round disjoint pairs of columns are rotated until every pair is orthogonal to working precision.  The rounds of a sweep meet all pairs, as
    in a tournament.  Columns are scaled first, so no square overflows.
    """
    d = r.shape[1]
    scale = float(np.abs(r).max(initial=0)) or 1.0
    a = np.zeros((max(r.shape), d))
    a[: len(r)] = r / scale
    v = np.eye(d)
    players = np.arange(d + d % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            p, q = players[:half], players[: half - 1 : -1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.where(size > 0, np.abs(gamma) / np.where(size > 0, size, 1), 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > 1e-16
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1), 0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst < 1e-15:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return v[:, order] / np.linalg.norm(v[:, order], axis=0), lengths[order] * scale


def fit_whitening(vectors: DataFrame, components: int, *, vector: str = "x") -> Whitening | None:
    """A fit on the distinct vectors of ``vectors``, which are usable and of one length; None where there are none."""
    fit = staged(_packed(vectors.select(vector)), "fit")
    first = vectors.select(F.size(vector).alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _sums(fit, d)
    found = Whitening(n, sums, np.empty((d, 0)), np.empty(0), np.empty(0))
    mean = found.mean
    v, lengths = jacobi(_triangle(fit, mean))
    lengths = np.where(lengths > d * np.finfo(float).eps * max(lengths.max(initial=0), float(np.abs(mean).max()) * 1e-3), lengths, 0)  # what rounding leaves counts as nothing
    energy = lengths**2
    k = min(components, d)
    found.components, found.deviations = v[:, :k], lengths[:k] / np.sqrt(n)
    found.shares = energy[:k] / energy.sum() if energy.sum() > 0 else np.zeros(k)
    found.identity_error = _identity_error(fit, found)
    return found


def _identity_error(fit: DataFrame, found: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity; whitened rows are centred before they are multiplied."""
    live = np.flatnonzero(found.deviations > 0)
    d, k = found.components.shape[0], len(live)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = found.whitened(_unpacked(b, d))[:, live]
                total += w.sum(0)
                squares += w.T @ w
        values = [*total.tolist(), *squares.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["at", "total"])

    told = {r["at"]: r["total"] for r in fit.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    values = np.array([told[i] for i in range(k + k * k)]) / found.n
    covariance = values[k:].reshape(k, k) - np.outer(values[:k], values[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def usual_length(vectors: DataFrame, vector: str) -> int | None:
    """The most frequent length of the usable vectors, the longer one of equals."""
    found = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found and found["d"]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S) ** 2) of each row, exact; None beyond a long."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums))
    if most * most * len(sums) < 2**62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v <= LONG.max else None for v in exact]


def whiten(vectors: DataFrame, components: int = 4, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component int, n long, deviation long, whitened double, explained double, identity_error double): a row for each usable vector and component."""
    kind = dict(vectors.dtypes)[key]
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kind)
    d = usual_length(vectors, vector)
    chosen = vectors.where(usable(vector) & (F.size(vector) == F.lit(d or 0))).select(vectors[key].alias("id"), vectors[vector].cast("array<double>").alias("x"))
    found = fit_whitening(chosen, components) if d else None
    share = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = share.value
        k = len(fit.shares) if fit else 0
        for b in batches:
            if not b.num_rows or not k:
                continue
            x = whole(matrix(b.column("x")))
            rows, w = len(x), fit.whitened(x)
            deviation = deviations(x, fit.n, fit.sums)
            repeat = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(repeat)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fit.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(repeat)),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel()),
                    pa.array(np.tile(fit.shares, rows)),
                    pa.array([fit.identity_error] * (rows * k), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", key)
