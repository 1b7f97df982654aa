"""Best-fit packing against packing one by one, and the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import best_fit, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "a", "=" * 999, "naïve 中文 🙂", "x<|endoftext|>y", "word " * 300, "word " * 127, "word " * 63, "same", "same"]


def one_by_one(lengths, capacity):
    """Windows of best fit decreasing, a piece at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits)[1]] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def filled(counts, capacity):
    steps, windows = best_fit.matched(counts, capacity)
    held, seen = [[] for _ in range(windows)], {x: [] for x in counts}
    for length, rank, n, window, each, offset in steps:
        for i in range(n):
            held[window + i // each].append((offset + i % each * length, length))
            seen[length].append(rank + i)
    assert all(sorted(seen[x]) == list(range(n)) for x, n in counts.items())
    for pieces in held:
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return held


@pytest.mark.parametrize("capacity", [1, 2, 3, 7, 30, 64, 2048])
def test_counts_are_packed_like_pieces(capacity):
    rng = random.Random(capacity)
    for _ in range(150):
        counts = {x: rng.randint(0, 9) for x in rng.sample(range(1, capacity + 1), rng.randint(0, min(capacity, 12)))}
        held = filled(counts, capacity)
        lengths = [x for x, n in counts.items() for _ in range(n)]
        assert -(-sum(lengths) // capacity) <= len(held) <= one_by_one(lengths, capacity) + 1
        assert all(sum(3 * length > capacity for _, length in pieces) <= 2 for pieces in held)


def test_large_pieces_pair_as_often_as_they_can():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(34, 100) for _ in range(rng.randint(1, 9))]
        best = len(lengths)

        def pairs(rest, windows):
            nonlocal best
            if not rest:
                best = min(best, windows)
                return
            pairs(rest[1:], windows + 1)
            for k in range(1, len(rest)):
                if rest[0] + rest[k] <= 100:
                    pairs(rest[1:k] + rest[k + 1 :], windows + 1)

        pairs(lengths, 0)
        assert len(filled({x: lengths.count(x) for x in lengths}, 100)) == best


def test_a_plan_does_not_grow_with_the_pieces():
    rng = random.Random(2)
    counts = {x: rng.randint(0, 50) for x in range(1, 2049)}
    few = len(best_fit.matched(counts, 2048)[0])
    many, windows = best_fit.matched({x: n * 1_000_003 for x, n in counts.items()}, 2048)
    assert few < 8_000 and len(many) < 8_000 and windows <= 1.01 * sum(x * n for x, n in counts.items()) * 1_000_003 / 2048


def check(rows, texts, capacity, end):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        whole, at = np.array([*LIBRARY.encode(texts[d] or "", add_special_tokens=False).ids, end], "<u4"), 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            assert p.length == capacity or k == 0
            at += p.length
        assert at == len(whole) and len(pieces) == -(-len(whole) // capacity)
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_window), sum(r.length for r in rows), [r.length for r in rows]


@pytest.mark.parametrize("capacity", [1, 5, 64])
def test_odd_documents(spark, capacity):
    frame = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(ODD)], "doc_id long, text string, length int, sequence_id int")
    windows, total, lengths = check(best_fit.best_fit(frame.repartition(3), PATH, 0, capacity=capacity).collect(), dict(enumerate(ODD)), capacity, 0)
    assert windows <= one_by_one(lengths, capacity)
    assert best_fit.best_fit(frame.where("false"), PATH, 0).count() == 0
    nameless = best_fit.best_fit(frame.withColumn("doc_id", F.lit(None).cast("long")), PATH, 0, capacity=capacity).collect()
    assert len(nameless) == len(lengths) and all(r.doc_id is None for r in nameless)


def test_windows_do_not_depend_on_partitions(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = [best_fit.best_fit(frame.repartition(n), PATH, 0).select("sequence_id").distinct().count() for n in (1, 7)]
    assert told[0] == told[1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    windows, total, lengths = check(queries.op12_best_fit(spark, sf).collect(), texts, 2048, 0)
    assert windows <= one_by_one(lengths, 2048) and windows <= 1.01 * total / 2048 + 1


def test_bad_capacities():
    with pytest.raises(ValueError):
        best_fit.pieces_of(None, PATH, 0, capacity=0)
