import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.functions.vectors import mean_vector
from tidewire.operators import claims, cluster, coverage, evidence, graph, ingest, market, nearest, resolve, search, study, timeline
from tidewire.operators.components import components

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ARTICLE = "id long, publisher_id string, published_at timestamp, title string, body string, mode string, embedding array<float>, story_id long, status string, score double"


def axis(plane, angle, dim=8):
    """A unit vector at an angle in one of the planes: the cosine inside a plane is that of the difference."""
    v = [0.0] * dim
    v[2 * plane], v[2 * plane + 1] = math.cos(angle), math.sin(angle)
    return v


def article(i, vector, publisher="p", hours=0, story=None, status=None, mode="feed_excerpt", title=None):
    return (i, publisher, T0 + timedelta(hours=hours), title or f"t{i}", f"body {i}", mode, vector, story, status, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, ARTICLE)


def stories_of(spark, articles, ids):
    base = spark.createDataFrame([(i, f"S{i}", "world", T0, T0 + timedelta(hours=1)) for i in ids], "story_id long, title string, category string, first_seen_at timestamp, last_seen_at timestamp")
    return cluster.with_centroids(base, articles)


NONE = "id long, story_id long"


def test_assignment_moves_the_centroid(spark):
    # each candidate is near the one before it; only a moving centroid takes the last one in
    step = math.acos(0.87)
    rows = [article(1, axis(0, 0), story=1, status="auto_accepted"), article(2, axis(0, step), hours=9), article(3, axis(0, step * 1.45), hours=8)]
    articles = frame(spark, rows)
    stories = stories_of(spark, articles, [1])
    start = F.lit(T0 + timedelta(hours=10))
    exact = {r.id: r.status for r in cluster.assign(articles, stories, spark.createDataFrame([], NONE), start).collect()}
    batch = {r.id: r.status for r in cluster.assign_batch(articles, stories, spark.createDataFrame([], NONE), start).collect()}
    assert exact == {"2": "auto_accepted", "3": "auto_accepted"}
    assert batch == {2: "auto_accepted"}


def test_assignment_review_band_refusals_and_closed_stories(spark):
    rows = [
        article(1, axis(0, 0), story=1, status="auto_accepted"), article(2, axis(1, 0), story=2, status="auto_accepted", mode="manual_fixture"), article(3, axis(2, 0), story=3, status="auto_accepted"),
        article(4, axis(0, math.acos(0.8)), hours=5), article(5, axis(1, 0), hours=5), article(6, axis(2, 0), hours=5),
    ]
    articles = frame(spark, rows)
    out = cluster.assign(articles, stories_of(spark, articles, [1, 2, 3]), spark.createDataFrame([(6, 3)], NONE), F.lit(T0 + timedelta(hours=6))).collect()
    assert [(r.id, r.story_id, r.status) for r in out] == [("4", "1", "pending_review")]


def test_cliques(spark):
    a = math.acos(0.9)
    rows = [article(1, axis(0, 0), "p"), article(2, axis(0, a), "q"), article(3, axis(0, 2 * a), "r"), article(4, axis(1, 0), "p"), article(5, axis(1, 0.01), "p"), article(6, axis(2, 0), "p")]
    out = {(r.group, r.id) for r in cluster.seed_groups(frame(spark, rows)).collect()}
    assert out == {(1, 1), (1, 2)}  # 3 is too far from 1; 4 and 5 share a publisher; 6 is alone


def test_cliques_ignore_row_order(spark):
    rows = [article(i, axis(i % 3, 0.05 * i), f"p{i % 4}", hours=i) for i in range(12)]
    a = {(r.group, r.id) for r in cluster.seed_groups(frame(spark, rows)).collect()}
    b = {(r.group, r.id) for r in cluster.seed_groups(frame(spark, rows[::-1])).collect()}
    assert a == b and a


def test_centroid_of_accepted_only(spark):
    rows = [article(1, axis(0, 0), story=1, status="auto_accepted"), article(2, axis(0, math.pi / 2), story=1, status="auto_accepted"), article(3, axis(1, 0), story=1, status="pending_review")]
    assert [round(x, 3) for x in cluster.centroids(frame(spark, rows)).first().centroid[:4]] == [0.5, 0.5, 0.0, 0.0]


def test_merge_and_unmerge(spark):
    rows = [article(1, axis(0, 0), story=1, status="auto_accepted"), article(2, axis(0, 0.1), story=2, status="auto_accepted", hours=5), article(3, axis(0, 0.2), story=2, status="pending_review")]
    articles = frame(spark, rows)
    stories = stories_of(spark, articles, [1, 2])
    moved, left, record = cluster.merge_stories(articles, stories, spark.createDataFrame([(1, 2)], "survivor long, merged long"))
    assert {r.story_id for r in moved.collect()} == {1} and left.count() == 1
    assert left.first().last_seen_at == datetime(2024, 1, 1, 5)
    assert moved.where("id = 3").first().score > 0.9
    back, again = cluster.unmerge(moved, left, record, stories)
    assert {r.id: r.story_id for r in back.collect()} == {1: 1, 2: 2, 3: 2} and again.count() == 2
    refused, _ = cluster.unmerge(moved.withColumn("story_id", F.when(F.col("id") == 2, 9).otherwise(F.col("story_id"))), left, record, stories)
    assert refused.where("id = 3").first().story_id == 1


def test_namer(spark):
    stories = spark.createDataFrame([(1, "old", "world"), (2, "kept", "world")], "group long, title string, category string")
    heads = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "group long, position int, title string")
    named = cluster.named_stories(stories, heads, lambda t: '{"title": "%s", "category": "health"}' % "+".join(t) if len(t) > 1 else "?")
    assert {(r.group, r.title, r.category) for r in named.collect()} == {(1, "a+b", "health"), (2, "kept", "world")}


def test_evidence_pick(spark):
    rows = [article(i, axis(0, 0.3 + 0.01 * i), "one" if i < 6 else f"p{i}", hours=i, story=1, status="auto_accepted") for i in range(14)]
    rows.append(article(20, axis(0, 0.3), "zz", hours=99, story=1, status="auto_accepted"))  # equals the earliest: never with it
    got = evidence.select_evidence(evidence.ranked_candidates(frame(spark, rows)), Config(near_duplicate=0.999999)).collect()
    ids = {r.id for r in got}
    assert len(got) == 10 and [r.evidence_id for r in got] == [f"A{i}" for i in range(1, 11)]
    assert 0 in ids and 20 not in ids and sum(i < 6 for i in ids) == 2
    assert {r.reason for r in got} == {"earliest_reporting", "latest_reporting", "centroid_rank"}
    assert [r.source_rank for r in got] == sorted(r.source_rank for r in got)


@pytest.mark.parametrize("pool", [1, 3, 64])
def test_evidence_pick_equals_one_long_fold(spark, pool):
    cfg = Config(near_duplicate=0.995)
    rng = random.Random(5)
    rows = [article(i, axis(0, rng.choice([0.1 * rng.randrange(12), rng.random()])), f"p{rng.randrange(5)}", hours=rng.randrange(30), story=i % 3, status="auto_accepted") for i in range(90)]
    ranked = evidence.ranked_candidates(frame(spark, rows)).select("story_id", "id", "publisher_id", "published_at", "source_rank", "embedding")
    want = set()
    for story in range(3):
        part = [r for r in ranked.collect() if r.story_id == story]
        cos = lambda x, y: float(np.dot(x.embedding, y.embedding) / np.linalg.norm(x.embedding) / np.linalg.norm(y.embedding))
        by_date = sorted(part, key=lambda r: (r.published_at, r.id))
        held = [by_date[0]]
        free = lambda r: all(r.id != h.id and cos(r, h) <= cfg.near_duplicate for h in held)  # noqa: B023, E731
        held += [r for r in by_date[::-1] if free(r)][:1]
        for r in sorted(part, key=lambda r: r.source_rank):
            if len(held) < cfg.evidence_max and free(r) and sum(h.publisher_id == r.publisher_id for h in held) < cfg.evidence_per_publisher:
                held.append(r)
        want |= {(story, r.id, f"A{k}") for k, r in enumerate(sorted(held, key=lambda r: r.source_rank), 1)}
    assert {(r.story_id, r.id, r.evidence_id) for r in evidence.select_evidence(ranked, cfg, pool).collect()} == want


def test_evidence_of_no_articles(spark):
    assert evidence.select_evidence(evidence.ranked_candidates(frame(spark, []))).collect() == []


def test_assignment_in_small_batches_equals_one_fold(spark):
    rng = random.Random(9)
    rows = [article(i, axis(0, 0.5 * i), hours=1, story=i, status="auto_accepted") for i in range(4)]
    rows += [article(10 + i, axis(0, 2 * rng.random()), hours=2 + rng.randrange(20)) for i in range(60)]
    articles, start = frame(spark, rows), F.lit(T0 + timedelta(hours=30))
    none = spark.createDataFrame([(12, 1)], NONE)
    run = lambda: {(r.id, r.story_id, round(r.similarity, 9), r.status) for r in cluster.assign(articles, stories_of(spark, articles, [0, 1, 2, 3]), none, start).collect()}
    whole = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {i: [np.array(axis(0, 0.5 * i), np.float32).astype(float), 1] for i in range(4)}
    want = set()
    for r in sorted(rows[4:], key=lambda r: (-r[2].timestamp(), r[0])):
        v = np.array(r[6], np.float32).astype(float)
        score = {i: v @ (s / n) / np.linalg.norm(v) / np.linalg.norm(s / n) for i, (s, n) in state.items() if not (r[0] == 12 and i == 1)}
        best = max(score, key=score.get)
        if score[best] >= Config().review:
            accept = score[best] >= Config().similarity
            want.add((str(r[0]), str(best), "auto_accepted" if accept else "pending_review"))
            if accept:
                state[best] = [state[best][0] + v, state[best][1] + 1]
    assert {(i, s, status) for i, s, _, status in whole} == want


def test_pairs_of_large_articles_come_once(spark):
    rows = spark.createDataFrame([(1, str(i)) for i in range(23)] + [(2, "1"), (2, "2"), (3, "9")], "article_id long, entity_id string")
    found = sorted((r.article_id, r.a, r.b) for r in resolve.cited_pairs(rows, 4).collect())
    assert found == sorted((r.article_id, r.a, r.b) for r in resolve.cited_pairs(rows).collect()) and len(found) == 23 * 22 // 2 + 1


def test_read_through_keeps_nulls_but_no_outage(spark):
    asked = spark.createDataFrame([(k, T0) for k in "abcd"], "key string, asked_at timestamp")
    held = spark.createDataFrame([("a", None, T0 - timedelta(seconds=59)), ("b", 1.0, T0 - timedelta(seconds=60))], "key string, value double, stored_at timestamp")
    fetched = spark.createDataFrame([("a", 9.0, True), ("b", None, True), ("c", 3.0, False)], "key string, value double, ok boolean")
    answers, after = market.read_through(asked, held, fetched, 60)
    assert {(r.key, r.state, r.value) for r in answers.collect()} == {("a", "hit", None), ("b", "expired", None), ("c", "outage", None), ("d", "outage", None)}
    assert {(r.key, r.value) for r in after.collect()} == {("a", None), ("b", None)}


def test_auto_merges_keep_aliases_one_hop(spark):
    pairs = spark.createDataFrame([("person", "", "b", "c", 0.95), ("person", "", "a", "b", 0.92), ("person", "", "c", "d", 0.91), ("person", "", "x", "y", 0.7)], "kind string, feature_key string, survivor string, merged string, similarity float")
    assert {(r.name, r.target) for r in resolve.auto_merges(pairs).collect()} == {("c", "a"), ("b", "a")}


def test_refusals_follow_aliases(spark):
    refused = spark.createDataFrame([("person", "", "b", "z")], "kind string, feature_key string, name_a string, name_b string")
    alias = spark.createDataFrame([("person", "b", "", "zz")], "kind string, name string, feature_key string, target string")
    assert [(r.name_a, r.name_b) for r in resolve.resolved_refusals(refused, alias).collect()] == [("z", "zz")]


def test_prefix_filter_loses_no_pair(spark):
    names = ["john smith", "jon smith", "john smyth", "smith john", "joan smithe", "mary jones", "marie jones", "a b", "a c", "ab"]
    found = spark.createDataFrame([("person", n, "", 5 + i % 3, n) for i, n in enumerate(names)], "kind string, name string, feature_key string, articles int, canonical_name string")
    from tidewire.functions.trigram import similarity

    brute = found.alias("x").join(found.alias("y"), F.col("x.name") < F.col("y.name")).where(similarity(F.col("x.name"), F.col("y.name")) >= F.lit(0.6).cast("float"))
    assert resolve.merge_candidates(found).count() == brute.count() > 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 9)), min_size=1, max_size=25))
def test_edge_bound(spark, raw):
    pairs = {(min(a, b), max(a, b)): w for a, b, w in raw if a != b}
    got = {(r.a, r.b) for r in resolve.bounded_pairs(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight long"), 2).collect()}
    want = set()
    for node in range(9):
        ends = sorted((-w, b if a == node else a, (a, b)) for (a, b), w in pairs.items() if node in (a, b))
        want |= {p for _, _, p in ends[:2]}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=25))
def test_components(spark, raw):
    parent = list(range(21))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in raw:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for p in raw if p[0] != p[1] for x in p}
    got = {(r.id, r.component) for r in components(spark.createDataFrame(raw, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in linked}


def test_duplicates_need_related_domains(spark):
    day = datetime(2024, 1, 1, 23)
    row = lambda u, d, t, at=day: (u, d, t, at)
    schema = "url string, domain string, title string, published_at timestamp"
    new = spark.createDataFrame([row("n1", "news.a.example", "Big — news!"), row("n2", "b.example", "Big news"), row("n3", "a.example", "Big news", datetime(2024, 1, 2))], schema)
    held = spark.createDataFrame([row("h1", "a.example", "BIG NEWS")], schema)
    assert [(r.url, r.duplicate_of) for r in ingest.duplicate_pairs(new, held).collect()] == [("n1", "h1")]


def test_catch_up(spark):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(1, None, at(12, 0)), (2, at(11, 37), at(12, 0)), (3, at(12, 0), at(12, 0)), (4, at(1, 0), at(12, 0))], "i int, cursor timestamp, current timestamp")
    got = {r.i: (len(r.windows), r.skipped) for r in ingest.catch_up(rows).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (0, 0), 4: (1, 43)}


def test_rsi_published_series(spark):
    closes = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00]
    rows = lambda c: spark.createDataFrame([("T", T0.date() + timedelta(days=i), float(x)) for i, x in enumerate(c)], "ticker string, date date, adj_close double")
    assert round(market.rsi(rows(closes[:15])).first().rsi, 3) == 70.464
    assert round(market.rsi(rows(closes)).first().rsi, 2) == 66.25
    assert market.rsi(rows(closes[:14])).first().rsi is None
    assert market.rsi(rows([5] * 20)).first().rsi == 50 and market.rsi(rows(range(1, 20))).first().rsi == 100
    assert round(market.volatility(rows([100, 110] * 3 + [100])).first().volatility, 4) == 165.7411
    assert market.volatility(rows([100, 0, 1])).first().volatility is None
    assert market.sma(rows([1, 2, 3]), 4).first().sma is None and market.sma(rows([1, 2, 3]), 2).first().sma == 2.5


def test_sm2(spark):
    log = [(1, i, T0 + timedelta(days=i), g) for i, g in enumerate([5, 5, 5, 2, 4])]
    r = study.card_states(spark.createDataFrame(log, "card_id long, review_id long, reviewed_at timestamp, grade int")).first()
    # 2.6, 2.7, 2.8, then a lapse by 0.32, then unchanged
    assert (r.repetitions, round(r.ease, 4), r.days) == (1, 2.48, 1)


def test_timeline(spark):
    points = spark.createDataFrame([(0, 1, 10, 100), (0, 2, 10, 7300)], "g int, id long, story_id long, at long")
    none = points.where("false").select("g", "at")
    axis_row = timeline.axis(points, none, ["g"])
    assert axis_row.first().granularity == "hour" and [r.n for r in timeline.volume(points, axis_row, ["g"]).orderBy("bucket").collect()] == [1, 0, 1]
    only_events = timeline.axis(points.where("false"), points.select("g", "at"), ["g"])
    assert only_events.first().buckets == 3 and timeline.volume(points.where("false"), only_events, ["g"]).count() == 0
    long = points.union(spark.createDataFrame([(0, 3, 11, 86400 * 180)], points.schema))
    assert timeline.axis(long, none, ["g"]).first().granularity == "week"


def test_blindspots(spark):
    rows = [(s, x) for s, group in {"a": ["left"] * 4 + ["right"], "b": ["left", None, None], "c": ["left", "right"], "d": ["center"] * 3, "e": ["lean_right", "right"]}.items() for x in group]
    got = {r.story_id: r.blindspot for r in coverage.spectrum(spark.createDataFrame(rows, "story_id string, leaning string")).collect()}
    assert got == {"a": "left", "b": None, "c": None, "d": None, "e": "right"}


def test_list_query():
    q = coverage.parse_list_query({"page": "2", "pageSize": "5", "sort": "title:asc", "dateTo": "2024-01-01"}, ["at", "title"])
    assert (q.page, q.size, q.sort, q.descending) == (2, 5, "title", False) and q.end == datetime(2024, 1, 1, 23, 59, 59, 999000, tzinfo=timezone.utc)
    with pytest.raises(ValueError, match="; "):
        coverage.parse_list_query({"page": "0", "category": "gossip"}, ["at"])
    assert coverage.envelope(0, q)["totalPages"] == 1 and coverage.envelope(11, q)["totalPages"] == 3


def test_search_needs_every_word(spark):
    rows = [(1, "storm coast", "heavy rain", 1, "auto_accepted"), (2, "storm", None, 1, "auto_accepted"), (3, "coast storm", None, 1, "pending_review")]
    articles = spark.createDataFrame(rows, "id long, title string, body string, story_id long, status string")
    index = search.postings(articles, "id", "title", "body")
    empty = search.postings(articles.where("false"), "story_id", "title", "body")
    assert [r.id for r in search.lexical(articles, index, empty, ["storm", "coast"], 10).collect()] == [1]
    story = search.postings(spark.createDataFrame([(1, "coast storm", None)], "story_id long, title string, body string"), "story_id", "title", "body")
    assert [(r.id, r.lexical_rank) for r in search.lexical(articles, index, story, ["storm", "coast"], 10).collect()] == [(1, 1), (2, 2)]


def test_contradiction_and_full_text(spark):
    raw = '{"claims": [{"text": "They fail to mention it.", "claim_type": "consensus", "citations": ["A1"]}, {"text": "x", "claim_type": "contradiction", "sides": {"supports": ["A1"]}}]}'
    rows = spark.createDataFrame([(1, raw, "student", True, ["consensus", "contradiction"]), (2, raw, "student", False, ["consensus"])], "run_id long, raw string, lens string, full_text boolean, surfaced array<string>")
    cited = spark.createDataFrame([(1, "A1", 1), (2, "A1", 1)], "run_id long, evidence_id string, publisher_id long")
    got = {(r.run_id, r.claim_index): r.code for r in claims.judged_claims(rows, cited).collect()}
    assert got == {(1, 0): None, (1, 1): "unsupported_contradiction", (2, 0): "omission_language", (2, 1): "unsupported_contradiction"}


def test_advice(spark):
    texts = ["Investors should sell their shares", "The company will buy the plant", "PT $40", "pt $40", "Buy now", "a 12% upside"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(claims.gives_advice(F.col("t")).alias("x")).collect()]
    assert got == [True, False, True, False, True, True]


def test_excluded_names_stay_out_of_views(spark):
    entities = spark.createDataFrame([("1", "french"), ("2", "acme"), ("3", "bolt")], "id string, name string")
    edges = spark.createDataFrame([("1", "2", 1), ("2", "3", 1)], "a string, b string, article_id long")
    assert [(r.a, r.b) for r in graph.citation_base(edges, entities).collect()] == [("2", "3")]


def test_run_ledger_adds_up(spark):
    rows = spark.createDataFrame([(1, o, None if o != "failed" else f"m{i}") for i, o in enumerate(["inserted", "failed", "enriched", "duplicate"] * 7)], "run_id long, outcome string, failure string")
    r = ingest.run_ledger(rows).first()
    assert r.discovered == r.inserted + r.enriched + r.duplicate + r.rejected_by_policy + r.failed == 28 and len(r.messages) == 5


def test_nearest_story_is_the_same_either_way(spark):
    rows = [article(i, axis(i % 4, 0.1 * i), story=i, status="auto_accepted") for i in range(1, 9)]
    articles = frame(spark, rows)
    live = stories_of(spark, articles, range(1, 9))
    asked = frame(spark, [article(100 + i, axis(i % 3, 0.13 * i + 0.05)) for i in range(12)] + [article(200, [0.0] * 8)])
    refused = spark.createDataFrame([(100, 4), (101, 1), (101, 5)], NONE)
    told = lambda most: sorted((r.id, r.story_id, round(r.similarity, 9)) for r in cluster.nearest_story(asked, live, refused, most).collect())
    assert told(1 << 20) == told(0) and len(told(0)) == 12


def test_ranks_without_a_limit(spark):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("score"))
    order = [F.desc("score"), F.col("id")]
    whole = {r.id: r.k for r in search.ranked(rows.repartition(7), order, "k").collect()}
    assert whole == {r.id: r.k for r in search.ranked(rows, order, "k", 500).collect()} and sorted(whole.values()) == list(range(1, 501))


def test_similar_pairs_in_blocks(spark):
    rows = [article(i, axis(i % 3, 0.07 * i), f"p{i % 5}") for i in range(40)] + [article(99, [0.0] * 8)]
    told = lambda n: {(r.a, r.b, round(r.similarity, 9)) for r in cluster.similar_pairs(frame(spark, rows), 0.8, None, n).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum(x * y for x, y in zip(a[6], b[6], strict=True)) >= 0.8}
    assert told(1024) == told(7) and {(a, b) for a, b, _ in told(7)} == want
    by = {(r.a, r.b) for r in cluster.similar_pairs(frame(spark, rows), 0.8, "publisher_id", 3).collect()}
    assert by == {(a, b) for a, b in want if a % 5 == b % 5}


def test_nearest_story_is_the_same_in_one_part_and_in_many(spark):
    rng = np.random.default_rng(2)
    live = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(40, [0.0] * 6)], "story_id long, centroid array<float>")
    asked = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(60)] + [(60, [0.0] * 6)], "id long, embedding array<float>")
    refused = spark.createDataFrame([(i, s) for i in range(0, 60, 3) for s in range(0, 40, 2)], "id long, story_id long")
    told = [sorted((r.id, r.story_id, round(r.similarity, 9)) for r in cluster.nearest_story(asked, live, refused, most).collect()) for most in (1 << 20, 500)]
    assert cluster.nearest_story(asked, live.where("false"), refused).count() == 0
    assert told[0] == told[1] and len(told[0]) == 60 and all(i % 3 or s % 2 for i, s, _ in told[0])


@pytest.mark.parametrize(("seed", "targets", "spread", "pivots"), [(1, 300, 0.05, None), (2, 120, 1.0, 5), (3, 50, 0.3, 1), (4, 40, 0.2, 40)])
def test_nearest_by_cells_equals_all_pairs(spark, seed, targets, spread, pivots):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6))
    t = centres[rng.integers(0, 12, targets)] + spread * rng.standard_normal((targets, 6))
    q = centres[rng.integers(0, 12, 200)] + spread * rng.standard_normal((200, 6))
    t[1], t[2], q[0], q[1] = t[0], 0, 0, t[0]  # ties and zero vectors
    no = {i: sorted({int(x) for x in rng.integers(0, targets, 8)}) for i in range(0, 200, 3)} | {5: list(range(targets))}
    queries = spark.createDataFrame([(i, v, no.get(i)) for i, v in enumerate(q.tolist())], "id long, v array<double>, refused array<long>")
    got, report = nearest.nearest_by_cells(queries, spark.createDataFrame(list(enumerate(t.tolist())), "target long, v array<double>"), pivots)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = unit(q) @ unit(t).T
    s[:, 2] = -np.inf
    for i, out in no.items():
        s[i, out] = -np.inf
    want = {i: (int(np.flatnonzero(s[i] >= s[i].max() - 1e-12)[0]), round(s[i].max(), 9)) for i in range(1, 200) if np.isfinite(s[i].max())}
    assert {r.id: (r.target, round(r.similarity, 9)) for r in got.collect()} == want and 5 not in want
    assert report["compared"] <= report["pairs"] and (spread > 0.1 or report["compared"] < 0.4 * report["pairs"])


def test_medoids_equal_sums_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, 100 * g + i, (rng.standard_normal(5) + 1).tolist(), i, f"t{i}") for g in range(4) for i in range(1 + 5 * g)] + [(9, 900, [0.0] * 5, 1, "z")]
    got = {r.group: (r.id, r.total) for r in cluster.medoids(spark.createDataFrame(rows, "group long, id long, embedding array<double>, published_at long, title string")).collect()}
    for g in {r[0] for r in rows}:
        v = np.array([r[2] for r in rows if r[0] == g])
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        total = (unit @ unit.T).sum(1) - (unit * unit).sum(1)
        best = int(total.argmax())
        assert got[g][0] == [r[1] for r in rows if r[0] == g][best] and abs(got[g][1] - total[best]) < 1e-8


def test_automatic_merges_equal_one_long_fold(spark):
    rng = random.Random(6)
    pairs = {}
    for _ in range(120):
        a, b = rng.sample(range(40), 2)
        if (b, a) not in pairs:
            pairs[a, b] = rng.choice([0.9, 0.95, 1.0])
    rows = [(kind, "", f"n{a}", f"n{b}", s) for (a, b), s in pairs.items() for kind in ("person", "organization") if (a + b) % 3 or kind == "person"]
    want = set()
    for kind in ("person", "organization"):
        alias = {}
        for _, _, survivor, merged, _ in sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[4], r[2], r[3])):
            if survivor not in alias and merged not in alias:
                alias = {n: survivor if t == merged else t for n, t in alias.items()} | {merged: survivor}
        want |= {(kind, n, t) for n, t in alias.items()}
    frame = spark.createDataFrame(rows, "kind string, feature_key string, survivor string, merged string, similarity float")
    assert {(r.kind, r.name, r.target) for r in resolve.auto_merges(frame).collect()} == want


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i % 3, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(500)], "story_id long, embedding array<float>")
    told = [{r.story_id: tuple(r.centroid) for r in mean_vector(rows.repartition(n), "story_id", "embedding").collect()} for n in (1, 3, 7)]
    assert told[0] == told[1] == told[2]


def test_ranks_of_equal_scores_go_by_id(spark):
    articles = spark.createDataFrame([(i, 1, "auto_accepted") for i in (1, 2)], "id long, story_id long, status string")
    index = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 0.3), ("a", 2, 0.1 + 0.2), ("b", 2, 0.3)], "term string, id long, weight double")
    found = search.lexical(articles, index, spark.createDataFrame([], "term string, story_id long, weight double"), ["a", "b"])
    assert {r.id: r.lexical_rank for r in found.collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("width", [1024, 3])
def test_lists_of_articles_give_the_same_graph(spark, monkeypatch, width):
    monkeypatch.setattr(resolve, "LIST_NAMES", width)
    rng = random.Random(5)
    rows = [(a, rng.choice(["person", "organization", "theme", "location"]), rng.choice(["Ann", "ANN", "ann!", "Bo", "Cy", "Di-An", "Ed", "--", None]), rng.choice(["1", None])) for a in range(60) for _ in range(6)]
    annotations = spark.createDataFrame(rows, "article_id long, kind string, surface_name string, feature_id string")
    found = resolve.candidates(annotations)
    entities = resolve.promoted(found, spark.createDataFrame([], "kind string, name string, feature_key string, id string"))
    names, lists = resolve.listed(annotations)
    assert sorted(names.select(*found.columns).collect()) == sorted(found.collect())
    numbers = names.where("articles >= 5")
    weights = resolve.weights_in(lists, numbers)
    bounded = resolve.bounded_pairs(weights, 2)
    ids = numbers.select("n", F.col("id").alias("entity_id"))
    want = resolve.edges(resolve.mentions(annotations, entities), 2)
    assert sorted(resolve.named_pairs(resolve.edges_in(lists, bounded), ids).collect()) == sorted(want.select("a", "b", "article_id").collect())
    assert "cited" not in " ".join(weights.inputFiles()) and want.count() > 100
