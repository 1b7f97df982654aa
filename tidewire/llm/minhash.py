"""Near-duplicate documents by ProbMinHash, banding, verification and connected components.

A text's words (lower case, cut at white space) give shingles of five words, weighted by how often they occur.  Two texts
are near-duplicates at a probability Jaccard similarity of 0.8 or more,

    J_P(w, v) = sum over d of 1 / sum over d' of max(w[d'] / w[d], v[d'] / v[d]),

which for equal weights is the Jaccard similarity of the sets.  ProbMinHash estimates it: every shingle is a Poisson process
with its weight as rate, each arrival falls on a random slot of the signature, and a slot keeps the shingle that arrives first.  A
shingle stops as soon as its next arrival is later than every slot's, so the cost is about one arrival a shingle and m log m
a text.

1. Texts with equal word sequences are folded into classes; the rest of the work sees one text of each.
2. Signatures are cut into bands; classes with an equal band form a bucket.
3. In each bucket the class with the least doc_id is compared with the others, by their shingles.
4. Links so found give components.  Where members of a bucket still lie in several components, those of the largest one are compared
   with the others, and the others among themselves, in bounded blocks; pairs that are already connected are skipped.  So no link between members of a bucket that would join two components is lost,
   and large groups of copies, which step 3 connects, cost a comparison for each member.
5. Components of all links are the groups; the least doc_id stays.

Results for odd input: a null text counts as empty.  Texts without words are copies of each other.  A text of one to four
words has one shingle, all its words.  Inside, a class is known by a 128-bit digest of its words, so different texts under one doc_id are different
classes; in :func:`near_duplicates` the texts of one doc_id are then linked as one document and share a group, and a group in which no
row has a doc_id gets a negative number made from its least digest.  :func:`deduplicate` knows a row by its doc_id and its text.  An empty table gives an empty table; other columns are carried by :func:`deduplicate` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.components import components, contracted, labels
from tidewire.llm.shared import block_pairs, by_block, runs, slices, text_of
from tidewire.staging import joined_by_count, staged

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
BLOCK = 128
#: Rounds in which links with leaders are contracted before the members of a bucket are compared.
CONTRACTED = 3
ROUNDING = 1e-9
CACHED_WORDS = 300_000
#: Texts whose shingles one file holds.
SHINGLE_ROWS = 10_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out * np.uint64(3) + h[k : k + n])
    return np.unique(out, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """ProbMinHash signatures (docs x slots) of many texts at once; ``doc`` is each element's text.  Texts without elements get zeros."""
    first = np.full(docs * slots, np.inf)
    out = np.zeros(docs * slots, np.uint64)
    alive, rate, owner = elements, weights.astype(np.float64), doc.astype(np.int64)
    state, time = mixed(elements ^ np.uint64(0xA0761D6478BD642F)), np.zeros(len(elements))
    last = np.full(docs, np.inf)
    while len(alive):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mixed(state)
        time = time - np.log(((draw >> np.uint64(11)) + 1) * 2.0**-53) / rate
        going = time <= last[owner]
        alive, rate, owner, state, time, draw = (x[going] for x in (alive, rate, owner, state, time, draw))
        at = owner * slots + (mixed(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        out[at[won]] = alive[won]
        last = first.reshape(docs, slots).max(1)
    return out.reshape(docs, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for k in range(rows):
        out = mixed(out * np.uint64(3) + parts[:, :, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted shingle sets (sorted distinct hashes, positive weights)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    w, v = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum() - w.sum()), float(wb.sum() - v.sum())
    order = np.argsort(v / w)
    w, v = w[order], v[order]
    ratio = v / w
    upto = np.searchsorted(ratio, ratio, "right") - 1  # for these d', w[d'] / w[d] is the larger one
    w_sum, v_sum = np.cumsum(w), np.cumsum(v)
    return float((1 / ((w_sum[upto] + only_a) / w + (v_sum[-1] - v_sum[upto] + only_b) / v)).sum())


def overlap_bound(sets: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """An upper bound of the similarity of every two sets: the smaller of the weight shares that their common shingles have in either."""
    n, sizes = len(sets), [len(h) for h, _ in sets]
    hashes, row = np.concatenate([h for h, _ in sets]), np.repeat(np.arange(n), sizes)
    share = np.concatenate([c / max(1, c.sum()) for _, c in sets])
    _, column, often = np.unique(hashes, return_inverse=True, return_counts=True)
    common = often[column] > 1
    column = (np.cumsum(often > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    column, row, share = column[order], row[common][order], share[common][order]
    out = np.zeros((n, n))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        weight, held = np.zeros((n, columns), np.float32), np.zeros((n, columns), np.float32)
        weight[row[a:b], column[a:b] - first] = share[a:b]
        held[row[a:b], column[a:b] - first] = 1
        out += weight @ held.T
    empty = np.array(sizes) == 0
    return np.minimum(out, out.T) + 1e-4 + np.outer(empty, empty)  # single precision: never below the similarity


def _packed(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, raw, digest, bands) of every row of (id, text, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [words_of(t) for t in b.column(1).to_pylist()]
            digests = [_digest(w) for w in words]
            sets = [shingles(w) for w in words]
            doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
            keys = band_keys(signatures(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]), doc, len(sets), bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["id", "raw", "digest", "bands"])

    return docs.mapInArrow(run, "id long, raw long, digest binary, bands array<long>")


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


NAME = ["no_id", "id", "raw"]


def _named(key: Column, text: Column) -> list[Column]:
    """What a row is known by: its id, as two columns without null, and a hash of its text."""
    return [key.isNull().alias("no_id"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(text).alias("raw")]


def _with_shingles(texts: DataFrame) -> DataFrame:
    """(id, hashes, counts) of texts, packed; ``id`` is the digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [words_of(t) for t in b.column(0).to_pylist()]
            sets = [shingles(w) for w in words]
            columns = [map(_digest, words), (_packed(s, "<u8") for s, _ in sets), (_packed(c, "<u4") for _, c in sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["id", "hashes", "counts"])

    return texts.mapInArrow(run, "id binary, hashes binary, counts binary")


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within blocks of (block, id, side, part, low, high, hashes, counts).

    Rows whose ``side`` is equal are taken as connected already and are not compared.  In a block of two different parts
    only rows of different parts are compared.  Links that close a cycle inside the block are not looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches):
            if block.num_rows < 2:
                continue
            ids, side, part = (block.column(c).to_pylist() for c in ("id", "side", "part"))
            across = block.column("low")[0].as_py() != block.column("high")[0].as_py()
            sets = [(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4")) for h, c in zip(block.column("hashes").to_pylist(), block.column("counts").to_pylist(), strict=True)]
            group, links, parts = np.unique(np.array(side), return_inverse=True)[1], [], np.array(part)
            open_pairs = np.tril(group[:, None] != group[None, :]) & (overlap_bound(sets) >= threshold)
            if across:
                open_pairs &= parts[:, None] != parts[None, :]
            for i, j in np.argwhere(open_pairs).tolist():
                if group[i] != group[j] and similarity(*sets[i], *sets[j]) >= threshold - ROUNDING:
                    links.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return by_block(rows.select("block", "id", "side", "part", "low", "high", "hashes", "counts")).mapInArrow(run, "a binary, b binary")


def _across_sides(met: DataFrame) -> DataFrame:
    """Blocks (block, id, side, part, low, high) in which every two members of a bucket from different sides meet.

    The members of the largest side go to one chunk each, times the few chunks of the other members, which go to all of
    its chunks; the other members meet in pairs of blocks.  The rows grow with the largest side, not with its square.
    """
    chunks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64(F.lit(7), "id"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    major = met.where("is_major").withColumn("a", own("n_major")).withColumn("b", every("n_minor"))
    minor = met.where("not is_major").withColumn("b", own("n_minor")).withColumn("a", every("n_major"))
    sides = [F.xxhash64("bucket", F.lit(-1), "a", "b").alias("block"), "id", "side", (~F.col("is_major")).cast("int").alias("part"), F.lit(0).alias("low"), F.lit(1).alias("high")]
    grid = block_pairs(met.where("not is_major and n_minor > 1"), "bucket", "id", "n_minor", BLOCK)
    return major.select(*sides).union(minor.select(*sides)).union(grid.select("block", "id", "side", "part", "low", "high"))


def _signed_rows(texts: DataFrame, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of rows of (id, text): (id, raw, digest, bands), and one row a digest: (digest, bands, copies, least id, holder), ``holder`` the name of its first row."""
    signed = staged(_signed(texts.withColumn("raw", F.xxhash64("text")), bands, rows), "signatures")
    holder = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "raw")).alias("holder")
    classes = signed.groupBy("digest").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), holder)
    return signed, staged(classes, "classes")


def _links(texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of digests whose components are those of all similar pairs that meet in a band.

    The links with leaders are contracted for ``CONTRACTED`` rounds only: that leaves few members apart that are connected, which are compared once more than they need be, and what is
    contracted goes on into the components of all links.
    """
    order = F.struct(F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"), "digest")  # copies come after what they were made from
    placed = classes.select(order.alias("own"), F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "own")
    buckets = placed.groupBy("bucket").agg(F.min("own").alias("leader"), F.max("own").alias("most"), F.count(F.lit(1)).alias("n")).where("leader <> most")
    buckets = staged(buckets.select("bucket", F.col("leader.digest").alias("leader"), "n"), "buckets")
    placed = placed.select("bucket", "own.digest")
    met = buckets.agg(F.sum("n")).first()[0] or 0
    members = staged(joined_by_count(placed, buckets, ["bucket"], met), "members", met)

    wanted = members.select("digest").distinct().join(classes.select("digest", "holder.*"), "digest").select(*NAME)
    rows = texts.select(*_named(F.col("id"), F.col("text")), "text").groupBy(*NAME).agg(F.first("text").alias("text"))
    candidates = rows.join(wanted, NAME, "left_semi")
    content_of = staged(_with_shingles(candidates.select("text")), "shingles", met, file_rows=SHINGLE_ROWS)

    star = members.where("leader <> digest").select("leader", F.col("digest").alias("id")).distinct()
    sizes = staged(star.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leaders", met)
    dealt = joined_by_count(star, sizes, ["leader"], met).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK))))
    dealt = dealt.select("leader", "id", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")).alias("chunk"))
    heads = dealt.select("leader", F.col("leader").alias("id"), "chunk").distinct()
    sides = [F.xxhash64("leader", "chunk").alias("block"), "id"]
    # all but the leader are on one side: only the leader is compared with each
    in_star = dealt.select(*sides, F.lit(1).alias("side")).union(heads.select(*sides, F.lit(0)))
    first = staged(_star_links(in_star.join(content_of, "id"), threshold), "star")

    first = contracted(first, rounds=CONTRACTED)
    reached = labels(first)
    rest = members.join(reached.withColumnRenamed("id", "digest"), "digest", "left").select("bucket", F.col("digest").alias("id"), F.coalesce("component", "digest").alias("side"))
    rest = staged(rest, "sides", met)
    mark = F.xxhash64(F.lit(5), "id").cast("decimal(20,0)")
    sized = rest.groupBy("bucket", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("sum"), F.bit_xor(F.xxhash64("id")).alias("xor"))
    open_buckets = sized.groupBy("bucket").agg(
        F.max(F.struct("n", "side")).alias("major"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"), F.count(F.lit(1)).alias("sides")
    )
    once = open_buckets.where("sides > 1").groupBy("n", "sum", "xor", "major").agg(F.min("bucket").alias("bucket"))  # buckets with the same members
    once = staged(once.select("bucket", "n", F.col("major.side").alias("major"), F.col("major.n").alias("n_major"), (F.col("n") - F.col("major.n")).alias("n_minor")), "open", met)
    apart = joined_by_count(rest, once, ["bucket"], met).withColumn("is_major", F.col("side") == F.col("major"))
    second = staged(_verified(_across_sides(apart).join(content_of, "id"), threshold), "links")
    return first.select(F.col("u").alias("a"), F.col("v").alias("b")).union(second)


def _with_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, copies, least, component) of every class: ``component`` is the least digest of its group."""
    return classes.join(components(links).withColumnRenamed("id", "digest"), "digest", "left").select("digest", "copies", "least", F.coalesce("component", "digest").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, *, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id long, kept boolean) of every row; ``group_id`` is the least id of the group, ``kept`` marks it."""
    texts = docs.select(docs[key].cast("long").alias("id"), text_of(docs, text).alias("text"))
    signed, classes = _signed_rows(texts, bands, rows)
    several = signed.where("id is not null").groupBy("id").agg(F.min("digest").alias("b"), F.max("digest").alias("most"), F.count(F.lit(1)).alias("n")).where("b <> most").drop("most")
    several = staged(several, "several")
    repeated = several.agg(F.sum("n")).first()[0]
    links = _links(texts, classes, threshold)
    if repeated:  # the texts of one id are one document
        links = links.union(joined_by_count(signed.select("id", F.col("digest").alias("a")), several, ["id"], repeated).select("a", "b"))
    grouped = _with_groups(classes, links)
    nameless = -F.pmod(F.xxhash64("component"), F.lit(1 << 60)) - 1
    of_group = grouped.groupBy("component").agg(F.min("least").alias("group_id")).withColumn("group_id", F.coalesce("group_id", nameless))
    of_class = staged(grouped.join(of_group, "component").select("digest", "component", "copies", "group_id"), "groups")
    total = of_class.agg(F.sum("copies")).first()[0] or 0
    found = joined_by_count(signed.select("id", "digest"), of_class, ["digest"], total, n="copies")
    kept = F.coalesce(F.col("id") == F.col("group_id"), (F.col("group_id") == nameless) & (F.col("digest") == F.col("component")))
    return found.select(F.col("id").alias(key), "group_id", kept.alias("kept"))


def _star_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of each block's leader (side 0) with its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches):
            ids, side = block.column("id").to_pylist(), block.column("side").to_pylist()
            sets = [(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4")) for h, c in zip(block.column("hashes").to_pylist(), block.column("counts").to_pylist(), strict=True)]
            for lead in (i for i, s in enumerate(side) if s == 0):
                near = [ids[j] for j in range(len(ids)) if side[j] and similarity(*sets[lead], *sets[j]) >= threshold - ROUNDING]
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[lead]] * len(near), pa.binary()), pa.array(near, pa.binary())], ["a", "b"])

    return by_block(rows.select("block", "id", "side", "hashes", "counts")).mapInArrow(run, "a binary, b binary")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group stays: one row with the least doc_id, a null one last.

    A row is known by its doc_id and its text, so different texts under one doc_id, or under none, are different rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    carried = docs.toDF(*names)
    own = F.col(names[docs.columns.index(key)]).cast("long")
    texts = carried.select(own.alias("id"), text_of(carried, names[docs.columns.index(text)]).alias("text"))
    signed, classes = _signed_rows(texts, BANDS, ROWS)
    grouped = _with_groups(classes, _links(texts, classes, threshold))
    of_digest = classes.select("digest", "holder").join(grouped.select("digest", "component"), "digest")
    stay = of_digest.groupBy("component").agg(F.min("holder").alias("least")).select("least.*")
    marked = carried.select("*", *_named(own, text_of(carried, names[docs.columns.index(text)])))
    return marked.join(stay, NAME, "left_semi").dropDuplicates(NAME).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
