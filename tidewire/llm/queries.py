"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import best_fit, bpe, embedding_dedup, fingerprints, minhash, packing, periodic_runs, quality, secrets, sharding, token_counts, toxicity, whitening
from tidewire.llm.shared import slices, table, text_of
from tidewire.staging import shared_dir

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    decoded = bpe.decode_documents(encoded, tokenizer_path())
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secret_model(spark: SparkSession, docs: DataFrame) -> list[float]:
    """Markov models of random strings and of identifiers made of the words of ``docs``."""
    return secrets.train(secrets.random_strings(spark), secrets.ordinary_words(docs))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secret_model(spark, docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    kinds = [count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *kinds, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Token counts of every document.

    The documents come in two deliveries that share one cache: all of both are counted, and the second one finds the texts of the first stored.  The cache of a table lies in the shared
    folder under a digest of the table's path, so a second call over that table finds all its texts; a cache of one's own goes by ``cache``.
    """
    cache = cache or f"{shared_dir(spark)}/tidewire/token-cache/{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:32]}"
    docs, first = table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    counted = [token_counts.count_tokens(part, tokenizer_path(), cache) for part in (docs.where(first), docs.where(~first))]
    return counted[0].union(counted[1]).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93."""
    return embedding_dedup.find_links(table(spark, sf_dir, "embeddings"), 0.93)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the toxicity categories of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40).drop("row_number")


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document, by the crc32 of its id, the words from some place on repeat the first of them; a null id is none of these."""
    chosen = docs.select("doc_id", text_of(docs).alias("text"))

    def tail(doc, text: str) -> str:
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        words = [] if h % 10 else periodic_runs.words_of(text)
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [tail(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return chosen.mapInArrow(run, chosen.schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, every tenth with a periodic tail; the longest, and digests of all and of the collapsed text."""
    found = periodic_runs.find_runs(periodic_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    exponent = F.expr("1000 * best.length div -best.period").alias("exponent_milli")
    return digests.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), exponent, "runs_sha256", "collapsed_sha256")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few windows of 2,048 tokens as large-item matching and best fit need."""
    return best_fit.best_fit(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the four components of largest deviation."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality, op3_secrets, op4_packing, op5_token_counts, op6_embedding_dedup, op7_toxicity, op8_fingerprints, op9_minhash, op10_sharding, op11_runs, op12_best_fit, op13_whitening)
}
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reached(id, c) as (select vec_id, vec_id from v union select r.id, l.b from reached r join links l on r.c = l.a),
n as (select a, count(*) as n from links group by a), m as (select id, min(c) as c from reached group by id)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from v join m on m.id = v.vec_id left join n on n.a = v.vec_id
""",
}
