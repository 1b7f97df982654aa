"""Token counts through a digest cache.

The cache is a Parquet table (digest, n_tokens), partitioned by tokenizer: ``digest`` is the SHA-256 of the normalised content,
``tokenizer`` that of the tokenizer's file, so another version never meets old counts and its files are not read.  The
content is normalised only as far as the tokenizer itself does, which for byte-level files means not at all, but for null, which
counts as empty.  A call finds the distinct digests that the cache lacks, encodes one text for each and appends the counts; all rows then take
their count by a join on the digest.

Results for odd input: null and empty texts have 0 bytes and 0 tokens; null and repeated keys, repeated rows and repeated texts each get their
row, and a text is encoded once; an empty table gives an empty table; other columns are not read.  Two calls that append the same digest
at the same time do no harm: equal keys have equal counts, and the join reads one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.bpe import library_encoder, read_spec, spec_digest
from tidewire.llm.shared import slices, text_of
from tidewire.staging import joined_by_count, staged

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes long, n_tokens long) of every row; appends to ``cache`` what it lacks.

    Stored counts are cut to the digests asked for before they are shuffled.  Copies are folded before the shuffle of texts, by partial
    aggregation, so a text that a third of all rows share costs each task one row.  Texts cross the network once; the last
    join moves digests and counts alone, and leaves the rows of frequent digests where they are.
    """
    spark = docs.sparkSession
    content = read_spec(tokenizer)
    version, spec = spec_digest(content), spark.sparkContext.broadcast(content)
    texts = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = staged(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    asked = staged(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "asked")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).join(asked, "digest", "left_semi")
    hits = staged(stored.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = library_encoder(spec.value).ids
        for b in slices(batches):
            counts = pa.array([len(ids(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts], ["digest", "n_tokens"])

    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(hits, "digest", "left_anti")
    counted = staged(misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long"), "counted")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = staged(asked.join(hits.union(counted), "digest"), "known")
    total = known.agg(F.sum("n")).first()[0] or 0
    return joined_by_count(rows, known, ["digest"], total).select(F.col("id").alias(key), "n_bytes", "n_tokens")
