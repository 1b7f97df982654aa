"""Encoding, counting and packing against the library, and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewire.llm import bpe, packing, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.model_of(bpe.read_spec(PATH))
ODD = [None, "", " ", "a", "a" * 30_000, "=" * 999, "\n\n\t x", "naïve 中文 🙂 ñ", "x<|endoftext|>y <|endoftext|>", "a\0b", "ꟲ ​  १२", "same", "same"]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1, b"z") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string, digest int, start binary")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_encode_any_text(text):
    assert ids(MODEL.encode(text)) == want(text)
    assert bpe.library_encoder(MODEL.spec).ids(text) == want(text)


def test_encode_joined_tokens():
    rng = random.Random(3)
    tokens = [t.decode("utf-8", "replace") for t in MODEL.rank]
    for _ in range(2000):
        text = "".join(rng.choices(tokens, k=rng.randint(1, 6)))
        assert ids(MODEL.encode(text)) == want(text)


def test_every_token_encodes_to_itself():
    assert all(MODEL.encode_word(t) == [r] for t, r in MODEL.rank.items())


def test_decode_bad_bytes():
    two = [i for i, t in ((i, t) for t, i in ((t, r) for t, r in MODEL.rank.items())) if t == b"\xc3"]
    packed = MODEL.packed[two[0]] * 2
    assert MODEL.decode(packed) == LIBRARY.decode(ids(packed), skip_special_tokens=False)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.BpeModel(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))


def test_documents(spark):
    got = bpe.decode_documents(bpe.encode_documents(docs(spark, ODD), PATH), PATH).collect()
    assert {r.doc_id: ids(r.ids) for r in got} == {i: want(t) for i, t in enumerate(ODD)}
    assert {r.doc_id: r.decoded for r in got} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode_documents(docs(spark, ["a"]).where("false"), PATH).count() == 0


def test_query_op1(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        packed = np.array(want(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = token_counts.count_tokens(docs(spark, ODD), PATH, cache).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in first} == {i: (len((t or "").encode()), len(want(t))) for i, t in enumerate(ODD)}
    distinct = len({t or "" for t in ODD})
    assert spark.read.parquet(cache).count() == distinct
    second = token_counts.count_tokens(docs(spark, [*ODD, "new"]), PATH, cache)
    assert second.count() == len(ODD) + 1 and spark.read.parquet(cache).count() == distinct + 1
    assert token_counts.count_tokens(docs(spark, ["a"]).where("false"), PATH, cache).count() == 0


def test_stored_counts_are_used(spark, tmp_path):
    cache = str(tmp_path / "cache")
    version = bpe.spec_digest(bpe.read_spec(PATH))
    rows = [(hashlib.sha256(b"known").digest(), 77, version), (hashlib.sha256(b"else").digest(), 99, "another version")]
    spark.createDataFrame(rows, token_counts.CACHE_SCHEMA).write.parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, ["known", "else"]), PATH, cache).collect()}
    assert got == {0: 77, 1: len(want("else"))}


def test_very_long_blank_runs_and_null_ids(spark, tmp_path):
    texts = [" " * 2_000_000 + "x", "a" + "\n" * 1_100_000, "b", "b"]
    rows = spark.createDataFrame([(None if i > 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(rows, PATH, str(tmp_path / "cache")).collect())
    assert counts == sorted((str(None if i > 1 else i), len(want(t))) for i, t in enumerate(texts))
    packed = packing.pack_documents(rows, PATH, 1).collect()
    assert sum(r.length for r in packed) == sum(n for _, n in counts) + 4 and sum(r.doc_id is None for r in packed) == 2
    encoded = bpe.encode_documents(rows, PATH).select("doc_id", "n_tokens").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in encoded) == counts


def check_packing(rows, texts, capacity):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        whole, at = np.array([*want(texts[d]), 1], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sum(capacity - sum(p.length for p in w) for w in by_window.values()) / (capacity * len(by_window))


def test_packing_odd_texts(spark):
    check_packing(packing.pack_documents(docs(spark, ODD), PATH, 1, capacity=64).collect(), dict(enumerate(ODD)), 64)
    assert packing.pack_documents(docs(spark, ["a"]).where("false"), PATH, 1).count() == 0


def test_query_op4(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packing(queries.op4_packing(spark, sf).collect(), texts, 2048) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing(lengths, k):
    window, sums = packing.differencing(np.array(lengths), k)
    assert sorted(np.bincount(window, lengths, k).astype(int)) == sorted(sums.tolist())
    windows, n = packing.windows_for(np.array(lengths), 100)
    assert np.bincount(windows, lengths, n).max() <= 100


def test_differencing_known_case():
    assert sorted(packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist()) == [14, 16]
