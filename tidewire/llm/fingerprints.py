"""Document fingerprints by I-Match with several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band of shares of the corpus (a band of inverse document
frequency).  A share has a lower end, so the lexicon is bounded: with t distinct terms a text on average
no more than t / low terms can lie above it (500,000 terms, 4 MB, for t = 250), however large the corpus; it is broadcast whole, and a text's fingerprint depends on
the shares of its terms alone.  A fingerprint hashes the sorted distinct
lexicon terms of a text: once all of them, and once for each of several random subsets of the lexicon, at
several densities, so that short and long texts both have subsets that hit few of their terms and that an edit can miss.  The likeness of two
fingerprints is the share of equal hashes among the sparsest subsets that hit a term of either text, ten of them or what there is.

To compare each text with the next one the rows are dealt into ranges of (id, hash of the text) and sorted inside them; each
range also gets a copy of the row that follows its last one.  The texts cross the network once.  Rows with one id
and many texts fall into many ranges.  Very many copies of one row are folded into one, which is compared with itself once and with its follower
once; the copies' results are unfolded afterwards.

Results for odd input: a null or empty text has no terms; a text with no lexicon term is hashed over all of its
terms; repeated ids follow each other in the order of their texts' hashes, the largest first; a null id comes last; the next of a
single row is that row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.minhash import mixed
from tidewire.llm.shared import sampled, slices, text_of
from tidewire.staging import hot_limit, staged

LOW, HIGH = 1 / 2000, 1 / 5
RATES = [2.0**-k for k in range(2, 9)]
SUBSETS_PER_RATE = 8
TOLD_LEAST = 10
EDGES = ".,;:!?\"'()[]{}<>|"
HELD_TERMS = 300_000
FIRST_ID = -(1 << 63)
PER_RANGE = 10
CHUNK = 10_000


def terms(text: str) -> set[str]:
    """The distinct terms of a text: lower-case words without punctuation around them."""
    out = {w.strip(EDGES) for w in set(text.lower().split())}
    out.discard("")
    return out


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all rows of (.., text); ``term`` is a 64-bit hash.  Each task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["term", "df"])
            counts.clear()
            return batch

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                counts.update(terms(t))
            if len(counts) >= HELD_TERMS:
                yield told()
        yield told()

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, total: int, low: float = LOW, high: float = HIGH, most: int | None = None) -> np.ndarray:
    """Sorted hashes of all terms in the band.  With ``most``, a lower end that would let in more is raised in steps of a twelfth of an octave."""
    band = document_frequencies(docs).where((F.col("df") >= max(2.0, low * total)) & (F.col("df") <= max(2.0, high * total)))
    if most is None:
        return np.sort(band.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    band = staged(band.withColumn("step", F.floor(12 * F.log2("df")).cast("int")), "lexicon")
    least, held = 0, 0
    for step, n in sorted(((r["step"], r["count"]) for r in band.groupBy("step").count().collect()), reverse=True):  # some hundred rows
        held += n
        if held > most:
            least = step + 1
            break
    chosen = band.where(F.col("step") >= least).select("term").toArrow()
    return np.sort(chosen.column(0).to_numpy().astype(np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprints over one lexicon."""

    def __init__(self, words: np.ndarray, seed: int = 11) -> None:
        self.words = words
        with np.errstate(over="ignore"):
            self.keys = mixed(np.arange(1, len(RATES) * SUBSETS_PER_RATE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + seed))
        self.limits = np.repeat(np.array([int(r * 2**63) for r in RATES], np.uint64), SUBSETS_PER_RATE)

    def of(self, text: str) -> tuple[str, ...]:
        """The hash of all lexicon terms, then that of each subset; empty where a subset hits no term."""
        found = terms(text)
        own = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        if len(self.words) and len(own):
            at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
            inside = own[self.words[at] == own]
            own = inside if len(inside) else own
        hit = (mixed(own[None, :] ^ self.keys[:, None]) >> np.uint64(1)) < self.limits[:, None]
        parts = [hashlib.blake2b(own.tobytes(), digest_size=8).hexdigest()]
        return (*parts, *[hashlib.blake2b(own[h].tobytes(), digest_size=3).hexdigest() if h.any() else "" for h in hit])


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of equal hashes among the sparsest subsets that hit either text; 1 for equal hashes over all terms."""
    if a[0] == b[0]:
        return 1.0
    told = 0
    same = 0
    for k in range(len(a) - SUBSETS_PER_RATE, 0, -SUBSETS_PER_RATE):  # one density after the other
        hit = [x == y for x, y in zip(a[k : k + SUBSETS_PER_RATE], b[k : k + SUBSETS_PER_RATE], strict=True) if x or y]
        told += len(hit)
        same += sum(hit)
        if told >= TOLD_LEAST:
            break
    return same / told if told else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class Bounds:
    """Cut points of the order (id, hash), smallest first; row ranges lie between them."""

    def __init__(self, cuts: list[tuple[int, int]]) -> None:
        self.ids, self.marks = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    def range_of(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many cut points lie below each row."""
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.unique(ids[high > low]):  # ids at a cut point: their hashes decide
            at, own = np.searchsorted(self.ids, i, "left"), ids == i
            low[own] = at + np.searchsorted(self.marks[at : np.searchsorted(self.ids, i, "right")], marks[own], "left")
        return low.astype(np.int32)


def _cuts(keys: DataFrame, count: int) -> Bounds:
    """About sqrt(n) / 2 ranges of equal size, from a sample of ``PER_RANGE`` keys a range."""
    ranges = max(8, math.ceil(math.sqrt(count) / 2))
    drawn = sorted(map(tuple, keys.where(sampled(F.xxhash64("at", "mark"), PER_RANGE * ranges, count, 3)).select("at", "mark").collect()))
    step = max(1, len(drawn) // ranges)
    return Bounds(drawn[step::step])


def fingerprint_documents(docs: DataFrame, *, low: float = LOW, high: float = HIGH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    read = docs.select(docs[key].cast("long").alias("id"), text_of(docs, text).alias("text"))
    read = read.withColumns({"at": F.coalesce("id", F.lit(FIRST_ID)), "mark": F.xxhash64("text")})
    keys = staged(read.groupBy("at", "mark").agg(F.count(F.lit(1)).alias("copies")), "keys")
    count, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    words = spark.sparkContext.broadcast(lexicon(read, total, low, high))
    bounds = _cuts(keys, count)
    often = keys.where(F.col("copies") > hot_limit(total))
    # one row for many copies: folded in each task first
    alone = read.join(F.broadcast(often), ["at", "mark"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
    folded = read.join(F.broadcast(often), ["at", "mark"]).groupBy("id", "at", "mark", "copies").agg(F.first("text").alias("text"))
    folded = staged(folded, "copies")

    @F.pandas_udf("int")
    def range_of(at: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(bounds.range_of(at.to_numpy(np.int64), mark.to_numpy(np.int64)))

    first = keys.groupBy(range_of("at", "mark").alias("range")).agg(F.max(F.struct("at", "mark")).alias("first"))
    firsts = {r["range"]: tuple(r["first"]) for r in first.collect()}  # one row a range
    filled = sorted(firsts)
    donors = {firsts[r]: above for r, above in zip(filled, [*filled[1:], *filled[:1]], strict=True)}  # the first row of a range follows the last of the range above
    donor_ids = np.array(sorted({i for i, _ in donors}), np.int64)

    @F.pandas_udf("array<int>")
    def places(at: pd.Series, mark: pd.Series) -> pd.Series:
        ids, marks = at.to_numpy(np.int64), mark.to_numpy(np.int64)
        out = [[2 * r] for r in bounds.range_of(ids, marks).tolist()]
        for k in np.flatnonzero(np.isin(ids, donor_ids)).tolist():
            above = donors.get((int(ids[k]), int(marks[k])))
            if above is not None:
                out[k].append(2 * above + 1)
        return pd.Series(out)

    rows = alone.select("id", "at", "mark", "text").union(folded.select("id", "at", "mark", "text"))
    dealt = rows.withColumn("place", F.explode(places("at", "mark"))).withColumn("range", F.floor(F.col("place") / 2).cast("int"))
    ordered = dealt.repartition("range").sortWithinPartitions("range", "place", F.desc("at"), F.desc("mark"))

    def results(prints: Fingerprints, row: tuple, own: tuple[str, ...], following: str, theirs: tuple[str, ...]) -> tuple:
        changed = edited(row[1], following)
        after = prints.of(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return row[0], len(row[1]), digest, ":".join(own), ":".join(after), likeness(own, after), likeness(own, theirs), row[2]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*names, "copies"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the next one of its range."""
        prints, last, own, at = Fingerprints(words.value), None, (), 0
        for b in slices(batches):
            out = []
            for i, t, place in zip(*(b.column(c).to_pylist() for c in ("id", "text", "place")), strict=True):
                if last is not None and at // 2 != place // 2:
                    last = None
                if last is not None and at % 2:
                    continue  # a copy of a repeated row; the first was enough
                theirs = prints.of(t)
                if last is not None:
                    out.append(results(prints, last, own, t, theirs))
                last, own, at = (i, t, 1), theirs, place
            if out:
                yield batch_of(out)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with itself: all copies but the last are followed by their like."""
        prints = Fingerprints(words.value)
        for b in slices(batches):
            out = []
            for i, t, copies in zip(*(b.column(c).to_pylist() for c in ("id", "text", "copies")), strict=True):
                own = prints.of(t)
                out.append(results(prints, (i, t, copies), own, t, own))
            if out:
                yield batch_of(out)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    one = ordered.select("id", "text", "place").mapInArrow(followed, schema)
    told = folded.select("id", "text", F.lit(0).alias("place"), "copies").mapInArrow(alike, schema)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / CHUNK))).alias("chunk")
    chunks = told.select("*", chunk).repartition("edited_sha256", "chunk")
    more = chunks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("copies") - 1 - F.col("chunk") * CHUNK))))
    return one.select(*names).union(more.select(*names)).withColumnRenamed("id", key)
