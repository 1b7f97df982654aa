"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import periodic_runs as P
from tidewire.llm import queries

ODD = [None, "", " \t\r\n\x0b\x0c ", "one", "a " * 5, "a " * 40, "a b c " * 30, "x " * 11, "x " * 12, "    \x85 \x1c " * 20, "é🙂 " * 50, "same same", "same same", "z" * 100_000, "p q " * 30_000]


def plain_runs(t, least):
    """Every period by itself."""
    t = np.unique(np.array(t), return_inverse=True)[1] if len(t) else np.zeros(0, int)
    out = []
    for q in range(1, len(t) // 2 + 1):
        step = np.diff(np.concatenate([[0], (t[q:] == t[:-q]).astype(int), [0]]))
        for s, f in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            length = f - s + q
            word = t[s : s + length]
            if length >= max(least, 2 * q) and not any(q % d == 0 and (word[d:] == word[:-d]).all() for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 12))
def test_runs_of_any_string(letters, least):
    got = P.runs_of(np.array([*letters, 99]), least)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_runs(letters, least)


def repetitive(rng):
    n, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 8])
    text = [str(rng.randrange(letters)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 20)
            b = rng.randint(a, n)
            text[a:b] = [text[a + (i - a) % p] if a + (i - a) % p < n else text[a] for i in range(a, b)]
    return text


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_many_texts_at_once(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        assert [[tuple(r) for r in x.tolist()] for x in P.runs_of_all(texts, least)] == [plain_runs(t, least) for t in texts]


def test_strings_with_very_many_runs():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    for t in (list(b), [str(x) for x in thue], ["x"] * 1500, (["x"] * 30 + ["y"]) * 40):
        assert [tuple(r) for r in P.runs_of_all([t], 12)[0].tolist()] == plain_runs(t, 12)


def test_the_vocabulary_covers_the_leftmost_repeats():
    """Every tandem repeat of a string without powers is walked to from a pair at its leftmost place."""
    rng = random.Random(8)
    for _ in range(200):
        t = [rng.randrange(3) for _ in range(rng.randint(3, 50))]
        tree = P.SuffixTree(np.array([*t, 9]))
        at, period = P.walked(tree, *P.without_powers(tree, *P.leftmost_pairs(tree)))
        walked = {(tuple(t[i : i + 2 * k])) for i, k in zip(at.tolist(), period.tolist(), strict=True)}
        want = {tuple(t[i : i + 2 * k]) for k in range(1, len(t) // 2 + 1) for i in range(len(t) - 2 * k + 1) if t[i : i + k] == t[i + k : i + 2 * k] and not any(k % d == 0 and t[i : i + k] == t[i : i + d] * (k // d) for d in range(1, k))}
        assert walked == want


def test_long_texts_take_little_time():
    began = time.monotonic()
    assert P.runs_of_all([["w"] * 400_000], 12)[0].tolist() == [[0, 400_000, 1]]
    periodic = [f"w{i % 130_000}" for i in range(400_000)]
    assert P.runs_of_all([periodic], 12)[0].tolist() == [[0, 400_000, 130_000]]
    assert time.monotonic() - began < 30


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "k l " * 20, 2, "y")], "doc_id long, text string, runs int, collapsed string")


def test_odd_documents(spark):
    got = {r.doc_id: r for r in P.find_runs(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD) + 1 and [tuple(r) for r in got[None].runs] == [(0, 40, 2)]
    for i, t in enumerate(ODD):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words, 12) if len(words) < 1000 else [(0, 60_000, 2)]
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == runs and got[i].collapsed == " ".join(w for j, w in enumerate(words) if j not in gone)
    assert P.find_runs(docs(spark, ODD).where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_runs(spark, sf).collect()}
    assert got.keys() == texts.keys() and sum(r.n_runs > 0 for r in got.values()) > 10
    for i, text in texts.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs, r = plain_runs(words, 12), got[i]
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
