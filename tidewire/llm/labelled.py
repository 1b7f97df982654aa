"""Labelled rows for the two classifiers: which may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import sampled

FOLDS = 5
SAMPLE = 20_000


def held_out(key: Column) -> Column:
    """Whether a row's label is kept back: crc32 of the id as text is a multiple of 5.  A null id is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def teaching_sample(labels: DataFrame, target: str, sample: int = SAMPLE, *, key: str = "doc_id") -> DataFrame:
    """(id, label) of about ``sample`` labelled rows at most, chosen by a hash of the id; repeated labels are averaged.

    Small enough to broadcast: the bound is the parameter, whatever the number of labels.  A sample below one row is refused.
    """
    if sample < 1:
        raise ValueError("a sample needs one row at least")
    known = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("id")).agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    total = known.count()
    return known.where(sampled("id", sample, total, 17))
