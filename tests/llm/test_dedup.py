"""Near-duplicates, fingerprints and components against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidewire.llm import embedding_dedup, fingerprints, minhash, queries, sharding

WORDS = [f"w{i}" for i in range(400)]


def grouped(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def probability_jaccard(a, b):
    """By the definition, over word tuples."""

    def counts(text):
        w = text.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = counts(a), counts(b)
    if not x or not y:
        return float(not x and not y)
    union = {*x, *y}
    return sum(1 / sum(max(x[d] / x[s], y[d] / y[s]) for d in union) for s in x if s in y)


def corpus(seed=1):
    rng, out = random.Random(seed), []
    for _ in range(40):
        base = rng.choices(WORDS, k=rng.randint(5, 120))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(WORDS)
            out.append(" ".join(near))
    return out


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", i, 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, group_id int, digest int")


def test_similarity_is_the_definition():
    rng = random.Random(2)
    for _ in range(50):
        base = rng.choices(WORDS[:30], k=40)
        other = base[:30] + rng.choices(WORDS[:30], k=10) + base[:10] * rng.randint(0, 2)
        sets = [minhash.shingles(minhash.words_of(" ".join(t))) for t in (base, other)]
        assert minhash.similarity(*sets[0], *sets[1]) == pytest.approx(probability_jaccard(" ".join(base), " ".join(other)))
        assert minhash.overlap_bound(sets)[0, 1] >= minhash.similarity(*sets[0], *sets[1])


def test_signatures_estimate_the_similarity():
    rng = random.Random(4)
    base = rng.choices(WORDS, k=300)
    other = base[:240] + rng.choices(WORDS, k=60)
    sets = [minhash.shingles(t) for t in (base, other)]
    signed = minhash.signatures(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]), np.repeat([0, 1], [len(s) for s, _ in sets]), 2, 4000)
    assert (signed[0] == signed[1]).mean() == pytest.approx(minhash.similarity(*sets[0], *sets[1]), abs=0.04)


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    want = grouped(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if probability_jaccard(texts[i], texts[j]) >= 0.8 - 1e-9])
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(7)
    base = rng.choices(WORDS, k=60)
    chain = [base[:]]
    for _ in range(30):  # neighbours are near, ends are not
        chain.append(chain[-1][1:] + [rng.choice(WORDS)])
    texts = [" ".join(t) for t in chain] + [" ".join(rng.choices(WORDS, k=50)) for _ in range(10)]
    want = grouped(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if probability_jaccard(texts[i], texts[j]) >= 0.8 - 1e-9])
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and want[30] == 0


def test_odd_documents(spark):
    texts = [None, "", " \n", "one", "One", "one two", "x " * 20_000, "x " * 20_000, "a b c d e f"]
    got = {r.doc_id: (r.group_id, r.kept) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i][0] for i in range(9)] == [0, 0, 0, 3, 3, 5, 6, 6, 8]
    rows = documents(spark, texts)
    kept = minhash.deduplicate(rows.union(rows))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 8]
    assert minhash.near_duplicates(rows.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "k l m n o p"), (None, "k l m n o p"), (4, "z")], "doc_id long, text string")
    assert len({r.group_id for r in minhash.near_duplicates(nulls).collect()}) == 2


def test_pairs_of_many_sides_meet_once_linked(spark):
    assert minhash.deduplicate(documents(spark, corpus(5))).count() == len({*grouped(len(corpus(5)), [(i, j) for i, j in itertools.combinations(range(len(corpus(5))), 2) if probability_jaccard(corpus(5)[i], corpus(5)[j]) >= 0.8 - 1e-9])})


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append(((base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.2])).astype(np.float32).tolist(), g % 3))
    return rows


@pytest.mark.parametrize("block, hot", [(512, 1000), (2, 2)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block, hot):
    from tidewire import staging

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(staging, "HOT_ROWS", hot)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, label, 9) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int, id int")
    unit = np.array([v for v, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine, label = unit @ unit.T, np.array([x for _, x in rows])
    linked = (cosine >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.find_links(frame, recall=0.99999).collect()}
    want = grouped(len(rows), np.argwhere(np.triu(linked)).tolist())
    assert found == {i: (int(linked[i].sum()), want[i]) for i in range(len(rows))}


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93001 * a + np.sqrt(1 - 0.93001**2) * b  # every pair lies at the threshold
    rows = [(int(i), v.tolist(), int(i) // 2) for i, v in enumerate(np.stack([a, near], 1).reshape(-1, 32))]
    got = embedding_dedup.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1").count() >= 0.99 * len(rows) and got.where("n_links > 1").count() == 0


def test_vectors_of_any_length_scale(spark):
    rows = [(i, [x * 3, x * 4], 1) for i, x in enumerate((1e200, 1e-200, 1.0, 5e-324))]
    assert [r.n_links for r in embedding_dedup.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()] == [3] * 4


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    got = embedding_dedup.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.n_links) == [(0, 3, 0), (1, 3, 0), (1, 3, 0), (2, 3, 0)]
    assert all(r.component_id == r.vec_id and r.kept for r in got if not r.n_links)
    assert embedding_dedup.find_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_fingerprints(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        r, changed = got[i], fingerprints.edited(texts[i], texts[following])
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_next == fingerprints.likeness(tuple(r.fingerprint.split(":")), tuple(got[following].fingerprint.split(":")))
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def plain_fingerprint(text, lexicon):
    """I-Match from its definition: digests of the sorted lexicon terms, whole and in each random subset, drawn term by term."""
    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    found = {w.strip(fingerprints.EDGES) for w in text.lower().split()} - {""}
    kept = sorted(xxhash.xxh3_64_intdigest(w) for w in (found & lexicon or found))
    told = [hashlib.blake2b(b"".join(h.to_bytes(8, "little") for h in kept), digest_size=8).hexdigest()]
    for k in range(56):
        subset = [h for h in kept if mix(h ^ mix((k + 1) * (0x9E3779B97F4A7C15 + 11) % 2**64)) >> 1 < int(2.0 ** -(2 + k // 8) * 2**63)]
        told.append(hashlib.blake2b(b"".join(h.to_bytes(8, "little") for h in subset), digest_size=3).hexdigest() if subset else "")
    return told


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    held = []
    for rate in range(6, -1, -1):
        if len(held) < 10:
            held += [x == y for x, y in zip(a[1 + 8 * rate : 9 + 8 * rate], b[1 + 8 * rate : 9 + 8 * rate], strict=True) if x or y]
    return sum(held) / len(held) if held else 0.0


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(400)], k=rng.randint(1, 80))) + rng.choice(["", ".", "!"]) for _ in range(120)]
    df = Counter(w for t in texts for w in {x.strip(fingerprints.EDGES) for x in t.lower().split()})
    lexicon = {w for w, n in df.items() if 0.05 * 120 <= n <= 0.2 * 120}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(rows, low=0.05).collect()}
    for i, t in enumerate(texts):
        own, after, following = plain_fingerprint(t, lexicon), plain_fingerprint(fingerprints.edited(t, texts[i - 1]), lexicon), plain_fingerprint(texts[i - 1], lexicon)
        assert (got[i].fingerprint.split(":"), got[i].edited_fingerprint.split(":")) == (own, after)
        assert (got[i].near_edited, got[i].near_next) == (plain_likeness(own, after), plain_likeness(own, following))


@pytest.mark.parametrize("hot", [1000, 3])
def test_rows_that_share_an_id_or_a_text(spark, monkeypatch, hot):
    from tidewire import staging

    monkeypatch.setattr(staging, "HOT_ROWS", hot)
    monkeypatch.setattr(fingerprints, "CHUNK", 4)
    rng = random.Random(4)
    rows = [(7, f"hot {rng.random()}") for _ in range(60)] + [(5, "copied text of one row")] * 25 + [(i, f"own {i} words") for i in (1, 3, 9)] + [(None, "nameless")] * 5
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    mark = {t: spark.sql("select xxhash64(:t)", {"t": t}).first()[0] for _, t in rows}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], mark[r[1]]), reverse=True)
    want = [(i, hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest()) for (i, t), (_, f) in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_lexicon_is_bounded(spark):
    rows = spark.createDataFrame([(f"a{i % 2} b{i % 5} c{i % 50} d{i}",) for i in range(100)], "text string")
    sizes = [len(fingerprints.lexicon(rows, 100, 0.01, 0.9, most)) for most in (1000, 57, 30, 5)]
    assert sizes == [57, 57, 7, 2]


def test_lexicon_band(spark):
    rows = spark.createDataFrame([("all rare%d mid" % i if i < 4 else "all",) for i in range(10)], "text string")
    assert len(fingerprints.lexicon(rows, 10, 0.15, 0.5)) == 1


def test_odd_fingerprints(spark):
    texts = [None, "", "a", "ab", "abc", "wort " * 30_000, "... !!", "same text", "same text"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "nameless", 1), (3, "ab", 1)], "doc_id long, text string, at int")
    got = fingerprints.fingerprint_documents(rows).collect()
    assert len(got) == len(texts) + 2
    at = {r.doc_id: r for r in got}
    assert at[7].fingerprint == at[8].fingerprint and at[8].near_next == 1.0 and at[0].n_chars == 0
    assert at[4].edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint_documents(rows.where("false")).count() == 0


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_are_reproducible_and_computable(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    a = {r.doc_id: (r.row_number, r.shard, r.slot) for r in sharding.shard_documents(rows, 7).collect()}
    b = {r.doc_id: (r.row_number, r.shard, r.slot) for r in sharding.shard_documents(rows.repartition(5).orderBy("text"), 7).collect()}
    assert a == b
    shard, slot = sharding.place(np.arange(500), 500, 7, 20240229)
    assert all((s, t) == (shard[n], slot[n]) for n, s, t in a.values())
    assert (sharding.unplace(shard, slot, 500, 7, 20240229) == np.arange(500)).all()
    assert len({s for s in shard[:50].tolist()}) == 7


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n, 5)
    assert sorted(image.tolist()) == list(range(n)) and (sharding.unpermute(image, n, 5) == np.arange(n)).all()


def plain_feistel(x, n, seed):
    """The same permutation, number by number."""
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    while True:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for r in range(sharding.ROUNDS):
            z = (right + seed * 0x100000001B3 + r * 0x5851F42D4C957F2D + 1) * 0x9E3779B97F4A7C15 % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            left, right = right, left ^ ((z ^ z >> 31) & ((1 << bits) - 1))
        x = left << bits | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [5, 1000])
def test_permutation_number_by_number(n):
    assert sharding.permute(np.arange(n), n, 20240229).tolist() == [plain_feistel(i, n, 20240229) for i in range(n)]


def test_copies_of_one_row_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3, "doc_id long, text string")
    got = sharding.shard_documents(rows, 4).collect()
    assert Counter(r.doc_id for r in got) == {1: 50, 2: 3} and sorted(r.row_number for r in got) == list(range(53))


def test_odd_rows_to_shard(spark):
    rows = spark.createDataFrame([(None, None, 1), (None, None, 1), (1, "a", 1), (1, "a", 1), (1, "b", 2)], "doc_id long, text string, size int")
    got = sharding.shard_documents(rows, 2).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter({(1, 17, zlib.crc32(b"a")): 2, (1, 17, zlib.crc32(b"b")): 1, (None, 16, 0): 2})
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sharding.shard_documents(rows.where("false"), 2).count() == 0


def test_near_copies_of_texts_that_share_an_id(spark):
    a, b = (random.Random(i).choices(WORDS, k=80) for i in (21, 22))
    near = [" ".join([*t[:-1], "changed"]) for t in (a, b)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near[0]), (3, near[1]), (4, " ".join(random.Random(23).choices(WORDS, k=80))), (-(1 << 63), None), (-(1 << 62) - 5, "")]
    for n in (1, 3):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted((r.doc_id, r.group_id, r.kept) for r in got) == [(-(1 << 63), -(1 << 63), True), (-(1 << 62) - 5, -(1 << 63), False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_dropped_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")], "doc_id long, text string, raw int, no_id string")
    assert [tuple(r) for r in minhash.deduplicate(rows).collect()] == [(1, "a b c d e f", 7, "x")]


def test_hot_buckets_and_copies(spark, monkeypatch):
    from tidewire import staging

    monkeypatch.setattr(staging, "HOT_ROWS", 2)
    texts = corpus(9) + corpus(9)[:30] * 3
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] == texts[j] or probability_jaccard(texts[i], texts[j]) >= 0.8 - 1e-9]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == grouped(len(texts), linked)


def test_different_texts_under_one_id_all_stay(spark):
    a, b = (" ".join(random.Random(i).choices(WORDS, k=60)) for i in (11, 12))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, "nameless text of its own"), (None, "nameless text of its own"), (3, None)]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (None, "nameless text of its own"), (3, None)], key=str)
