"""Deterministic stand-ins for the three outside providers: embeddings, prices, model answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: texts -> vectors
Embedder = Callable[[list[str]], list[list[float]]]


def _seed(text: str) -> int:
    """FNV-1a over the text's UTF-16 units, 32 bits."""
    h = 0x811C9DC5
    units = np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()
    for unit in units:
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def mock_embeddings(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors that depend on the text alone: FNV-1a seeds a xorshift generator of uniforms in -1..1."""
    state = np.array([_seed(t) or 1 for t in texts], np.uint32)
    out = np.empty((len(texts), dimensions))
    for k in range(dimensions):
        state ^= state << np.uint32(13)
        state ^= state >> np.uint32(17)
        state ^= state << np.uint32(5)
        out[:, k] = state / 0xFFFFFFFF * 2 - 1
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(texts) else out


def embedded(text: Column, provider: Embedder, dimensions: int = DIMENSIONS, batch: int = 32) -> Column:
    """Vectors of texts by a provider: cut to ``dimensions``, then brought to length 1; short vectors are an error, null texts stay null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        known = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            for i, v in zip(part, provider([texts.iloc[j] for j in part]), strict=True):
                v = np.asarray(v, np.float64)[:dimensions]
                if len(v) < dimensions:
                    raise ValueError(f"a vector of {len(v)} instead of {dimensions} numbers")
                out[i] = (v / (np.linalg.norm(v) or 1)).astype(np.float32)
        return out

    return run(text)


def mock_series(spark: SparkSession, tickers: list[str], days: int, until: str) -> DataFrame:
    """(ticker, date, adj_close) over the ``days`` days up to a date: a slow wave around a level that the ticker's name sets."""
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    day = F.explode(F.sequence(F.date_sub(F.to_date(F.lit(until)), days - 1), F.to_date(F.lit(until)), F.expr("interval 1 day")))
    level = 20 + F.pmod(F.xxhash64("ticker"), F.lit(400)).cast("double")
    wave = 1 + 0.1 * F.sin(F.unix_date("date") / 9.0 + F.pmod(F.xxhash64("ticker"), F.lit(7)).cast("double"))
    return names.select("ticker", day.alias("date")).where(F.weekday("date") < 5).withColumn("adj_close", F.round(level * wave, 4))


def mock_answer(evidence_ids: Column, lens: Column) -> Column:
    """A well-formed answer that cites the given evidence: a consensus claim and one for the lens."""
    claim = lambda text, kind: F.struct(F.lit(text).alias("text"), kind.alias("claim_type"), evidence_ids.alias("citations"))
    return F.to_json(F.struct(F.array(claim("The reports agree on the main event.", F.lit("consensus")), claim("The event matters to this reader.", lens)).alias("claims")))
