"""Queries: vectors, clustering, review, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.functions.vectors import mean_vector
from tidewire.operators import cluster, evidence
from tidewire.plans.registry import query
from tidewire.plans.views import Views, with_views
from tidewire.staging import staged

#: The driver's vectors lie far apart (the nearest at about 0.5), so these queries use lower thresholds than the defaults.
LOW = Config(similarity=0.4, review_gap=0.1, near_duplicate=0.4, recency_hours=8760)
START = 1704067200 + 10_000_000

MEAN = "cast(cast(sum(cast(floor(cast(x as double) * 4294967296.0 + 0.5) as bigint)) as double) / count(*) / 4294967296.0 as float)"
CENTROIDS = """
c as (select story_id, list(x order by pos) as centroid from (select story_id, pos, cast(cast(sum(cast(floor(cast(x as double) * 4294967296.0 + 0.5) as bigint)) as double) / count(*) / 4294967296.0 as float) as x from (select story_id, unnest(embedding) as x, unnest(range(len(embedding))) as pos from articles where status = 'auto_accepted' and embedding is not null) group by story_id, pos) group by story_id)
"""
COS = "list_cosine_similarity(cast({0} as double[]), cast({1} as double[]))"


@query(
    with_views(
        f"""
with {CENTROIDS.strip()}, r as (select a.story_id, a.id, a.publisher_id, a.at_s, 1 - {COS.format("a.embedding", "c.centroid")} as distance from articles a join c on a.story_id = c.story_id where a.status = 'auto_accepted' and a.embedding is not null and regexp_matches(a.body, '\\S')),
k as (select *, row_number() over (partition by story_id order by round(distance, 9), at_s, id) as source_rank from r),
p as (select *, row_number() over (partition by story_id, publisher_id order by source_rank) as publisher_rank from k),
t as (select *, row_number() over (partition by story_id order by source_rank) as pick from p where publisher_rank <= 2)
select story_id, id, publisher_id, source_rank, round(distance, 5) as distance from t where pick <= 10
""",
        "articles",
    )
)
def evidence_rank_capped(v: Views) -> DataFrame:
    """C4, G1: for each story the reports nearest to its centre, two a publisher."""
    rows = evidence.capped(evidence.ranked_candidates(v.articles))
    return rows.select("story_id", "id", "publisher_id", "source_rank", F.round("distance", 5).alias("distance"))


@query(with_views(f"with {CENTROIDS.strip()} select story_id, list_transform(centroid, lambda x: round(cast(x as double), 4) + 0.0) as centroid from c", "articles"))
def story_centroids(v: Views) -> DataFrame:
    """C4: centroids of stories."""
    return cluster.centroids(v.articles).select("story_id", F.transform("centroid", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0)).alias("centroid"))


@query(f"select a.vec_id as a, b.vec_id as b, round({COS.format('a.embedding', 'b.embedding')}, 5) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {COS.format('a.embedding', 'b.embedding')} >= 0.3")
def similar_vectors(v: Views) -> DataFrame:
    """Pairs of one label at a cosine of 0.3 or more."""
    rows = v.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    return cluster.similar_pairs(rows, 0.3, "label").select("a", "b", F.round("similarity", 5).alias("similarity"))


def _candidates(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles of which every third has no story yet, stories with centroids, refused pairs."""
    loose = (F.col("id") % 3 == 0) & F.col("embedding").isNotNull()
    articles = v.articles.withColumns({c: F.when(~F.coalesce(loose, F.lit(False)), F.col(c)) for c in ("story_id", "status")}).withColumn("score", F.lit(None).cast("double"))
    stories = cluster.with_centroids(v.stories, articles)
    rejected = articles.where("id % 3 = 0 and id % 4 = 0").select("id", (F.col("id") % 10).alias("story_id"))
    return articles, stories, rejected


LOOSE = "loose as (select * from articles where id % 3 = 0 and embedding is not null), articles2 as (select * from articles where not (id % 3 = 0 and embedding is not null))"


@query(
    with_views(
        f"""
with {LOOSE}, {CENTROIDS.strip().replace("from articles", "from articles2")},
s as (select l.id, c.story_id, {COS.format("l.embedding", "c.centroid")} as similarity from loose l cross join c join stories t on t.story_id = c.story_id where not (l.id % 4 = 0 and l.id % 10 = c.story_id)),
n as (select *, row_number() over (partition by id order by similarity desc, story_id) as k from s)
select id, story_id, round(similarity, 5) as similarity, case when similarity >= 0.2 then 'auto_accepted' else 'pending_review' end as status from n where k = 1 and similarity >= 0.1
""",
        "articles",
        "stories",
    )
)
def batch_assignment(v: Views) -> DataFrame:
    """Nearest live story of every candidate, with the centroids as they stand."""
    articles, stories, rejected = _candidates(v)
    out = cluster.assign_batch(articles, stories, rejected, F.timestamp_seconds(F.lit(START)), Config(similarity=0.2, review_gap=0.1, recency_hours=8760))
    return out.select("id", "story_id", F.round("similarity", 5).alias("similarity"), "status")


@query(
    with_views(
        f"""
with recursive {LOOSE}, {CENTROIDS.strip().replace("from articles", "from articles2")},
held as (select story_id, count(*) as n from articles2 where status = 'auto_accepted' and embedding is not null group by story_id),
start as (select list({{'j': cast(c.story_id as varchar), 's': list_transform(c.centroid, lambda x: cast(x as double) * held.n), 'n': held.n}} order by cast(c.story_id as varchar)) as state from c join held using (story_id) join stories using (story_id)),
queue as (select id, cast(embedding as double[]) as v, case when id % 4 = 0 then cast(id % 10 as varchar) else '' end as refused, row_number() over (order by at_s desc, cast(id as varchar)) as k from loose),
fold(k, id, state, j, sim) as (
select 0::bigint, null::bigint, state, null::varchar, null::double from start
union all
select k, id, case when sim >= 0.2 then list_transform(state, lambda x: case when x.j = b.j then {{'j': x.j, 's': list_transform(x.s, lambda y, i: y + v[i]), 'n': x.n + 1}} else x end) else state end, j, sim
from (select k, id, v, state, best.j as j, -best.a as sim from (select q.k, q.id, q.v, f.state,
list_sort(list_transform(list_filter(f.state, lambda x: x.j <> q.refused), lambda x: {{'a': -list_cosine_similarity(list_transform(x.s, lambda y: cast(cast(y / x.n as float) as double)), q.v), 'j': x.j}}))[1] as best from fold f join queue q on q.k = f.k + 1)) b)
select cast(id as varchar) as id, j as story_id, round(sim, 5) as similarity, case when sim >= 0.2 then 'auto_accepted' else 'pending_review' end as status from fold where sim >= 0.1
""",
        "articles",
        "stories",
    )
)
def sequential_assignment(v: Views) -> DataFrame:
    """The fold in which each acceptance moves its story."""
    articles, stories, rejected = _candidates(v)
    return cluster.assign(articles, stories, rejected, F.timestamp_seconds(F.lit(START)), Config(similarity=0.2, review_gap=0.1, recency_hours=8760)).withColumn("similarity", F.round("similarity", 5))


# a letter with a mark is the letter and a mark of its own, which is no letter
SLUG = r"regexp_replace(regexp_replace(list_aggregate(list_transform(string_split(lower(title), ''), lambda c: case when strip_accents(c) <> c then strip_accents(c) || '-' else c end), 'string_agg', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    with_views(
        f"""
with recursive loose as (select *, row_number() over (order by at_s desc, id) as k from articles where embedding is not null),
links as (select x.id as a, y.id as b, y.k, y.publisher_id <> x.publisher_id as apart from loose x join loose y on x.id <> y.id and {COS.format("x.embedding", "y.embedding")} >= 0.4),
adj as (select a, list(b) as near from links group by a),
around as (select l.a, list({{'id': l.b, 'apart': l.apart, 'm': [l.b], 'near': adj.near}} order by l.k) as near from links l join adj on adj.a = l.b group by l.a),
seeds as (select loose.k, loose.id, around.near from loose left join around on around.a = loose.id),
fold(k, members, placed) as (
select 0::bigint, null::bigint[], []::bigint[]
union all
select k, members, list_concat(placed, coalesce(members, []))
from (select k, placed, case when partner is not null then list_reduce(list_prepend({{'m': [id, partner], 'near': []::bigint[]}}, list_transform(list_filter(open, lambda x: x.id <> partner), lambda x: {{'m': x.m, 'near': x.near}})), lambda acc, x: case when list_has_all(x.near, acc.m) then {{'m': list_concat(acc.m, x.m), 'near': acc.near}} else acc end).m end as members
from (select k, id, placed, open, list_filter(open, lambda x: x.apart)[1].id as partner
from (select s.k, s.id, f.placed, case when not list_contains(f.placed, s.id) then list_filter(s.near, lambda x: not list_contains(f.placed, x.id)) end as open from fold f join seeds s on s.k = f.k + 1) o) p) q),
mem as (select members[1] as "group", unnest(members) as id from fold where members is not null),
own as (select mem."group", a.* from mem join articles a using (id)),
total as (select x."group", x.id, x.at_s, x.title, sum(case when x.id <> y.id then {COS.format("x.embedding", "y.embedding")} else 0 end) as total from own x join own y on x."group" = y."group" group by all),
medoid as (select "group", id, title from (select *, row_number() over (partition by "group" order by round(total, 9) desc, at_s, title, id) as r from total) where r = 1)
select medoid."group", medoid.id as medoid_id, title, case when short = '' then 'story' else short end || '-' || substr(cast(medoid.id as varchar), 1, 8) as slug, 'world' as category, first_at, members
from (select *, regexp_replace(substr({SLUG}, 1, 60), '-+$', '') as short from medoid) medoid join (select "group", min(at_s) as first_at, count(*)::int as members from own group by "group") spans using ("group")
""",
        "articles",
    )
)
def seeded_stories(v: Views) -> DataFrame:
    """Greedy cliques of loose articles, named after their medoids."""
    loose = staged(v.articles.where("embedding is not null").select("id", "publisher_id", "published_at", "title", "embedding"), "loose")
    members = staged(cluster.seed_groups(loose, LOW).join(loose, "id"), "members")
    return cluster.seed_stories(members).select("group", "medoid_id", "title", "slug", "category", F.unix_timestamp("first_seen_at").alias("first_at"), "members")


@query(
    with_views(
        f"""
with p as (select x.story_id, x.id, x.at_s, x.title, sum(case when x.id <> y.id then {COS.format("x.embedding", "y.embedding")} else 0 end) as total from articles x join articles y on x.story_id = y.story_id where x.status = 'auto_accepted' and y.status = 'auto_accepted' group by x.story_id, x.id, x.at_s, x.title)
select story_id, id, round(total, 4) as total from (select *, row_number() over (partition by story_id order by round(total, 9) desc, at_s, title) as k from p) where k = 1
""",
        "articles",
    )
)
def story_medoids(v: Views) -> DataFrame:
    """The medoid of each story."""
    return cluster.medoids(cluster.accepted(v.articles), "story_id").withColumn("total", F.round("total", 4))


@query(with_views("select id, case when status = 'pending_review' and id % 2 = 0 then null else status end as status, case when status = 'pending_review' and id % 2 = 0 then null else story_id end as story_id from articles", "articles"))
def stale_proposals(v: Views) -> DataFrame:
    """Pending assignments without a vector are void."""
    rows = v.articles.withColumn("embedding", F.when(F.col("id") % 2 == 1, F.col("embedding"))).withColumn("score", F.lit(0.5))
    return cluster.void_stale_proposals(rows).select("id", "status", "story_id")


@query(with_views("select id, title || chr(10) || coalesce(body, '') as embed_text from articles where embedding is null and mode in ('feed_excerpt', 'api_content', 'licensed_full_text')", "articles"))
def embedding_backlog(v: Views) -> DataFrame:
    """Articles to embed."""
    return cluster.embedding_backlog(v.articles).select("id", "embed_text")


@query(with_views("select a.id, s.title as story_title, p.domain from articles a join stories s on a.story_id = s.story_id join publishers p on a.publisher_id = p.publisher_id where a.status = 'pending_review'", "articles", "stories", "publishers"))
def review_queue(v: Views) -> DataFrame:
    """Pending assignments with story and publisher."""
    return cluster.pending_queue(v.articles.withColumn("score", F.lit(0.8)), v.stories, v.publishers).select("id", "story_title", "domain")


@query(
    with_views(
        """
select id, case when status = 'pending_review' and id % 4 < 2 then 'auto_accepted' when status = 'pending_review' and id % 4 = 2 then null else status end as status, case when status = 'pending_review' and id % 4 = 2 then null else story_id end as story_id from articles
""",
        "articles",
    )
)
def review_decisions(v: Views) -> DataFrame:
    """Decisions on pending assignments."""
    decisions = v.articles.where("id % 4 < 3").select("id", (F.col("id") % 4 < 2).alias("accept"))
    none = v.articles.where("false").select("id", "story_id")
    return cluster.decide(v.articles.withColumn("score", F.lit(0.8)), none, decisions)[0].select("id", "status", "story_id")


MERGES = [(1, 2), (3, 3), (4, 99), (5, 6)]


@query(
    with_views(
        """
with m as (select id, case when story_id = 2 then 1 when story_id = 6 then 5 else story_id end as story_id, status, at_s from articles)
select story_id, count(*)::int as members, min(at_s) as first_at, max(at_s) as last_at from m where status = 'auto_accepted' group by story_id
""",
        "articles",
    )
)
def merged_stories(v: Views) -> DataFrame:
    """Stories after merges, of which two are refused."""
    rows = v.articles.withColumn("score", F.lit(None).cast("double"))
    merges = v.spark.createDataFrame(MERGES, "survivor long, merged long")
    moved, stories, _ = cluster.merge_stories(rows, cluster.with_centroids(v.stories, rows), merges)
    counts = cluster.accepted(moved).groupBy("story_id").agg(F.count("*").cast("int").alias("members"))
    return stories.join(counts, "story_id").select("story_id", "members", F.unix_timestamp("first_seen_at").alias("first_at"), F.unix_timestamp("last_seen_at").alias("last_at"))


@query(
    with_views(
        """
with m(survivor, merged) as (values (1, 2), (3, 3), (4, 99), (5, 6), (7, 8)), shut as (select distinct story_id from articles where id % 50 = 7 and story_id = 7),
r as (select *, case when survivor = merged then 'same_story' when survivor not in (select story_id from stories) or merged not in (select story_id from stories) then 'not_found' when survivor in (select story_id from shut) or merged in (select story_id from shut) then 'curated' end as refusal from m)
select survivor, merged, refusal, case when refusal is null then (select list(id order by id) from articles where story_id = merged) end as article_ids from r
""",
        "articles",
        "stories",
    )
)
def merge_refusals(v: Views) -> DataFrame:
    """C14: why merges are refused, and which articles moved."""
    rows = v.articles.withColumns({"score": F.lit(None).cast("double"), "mode": F.when((F.col("id") % 50 == 7) & (F.col("story_id") == 7), "manual_fixture").otherwise(F.col("mode"))})
    merges = v.spark.createDataFrame([*MERGES, (7, 8)], "survivor long, merged long")
    return cluster.merge_stories(rows, cluster.with_centroids(v.stories, rows), merges)[2].select(F.col("survivor").cast("int"), F.col("merged").cast("int"), "refusal", "article_ids")


@query(with_views("select id, case when story_id = 6 then 5 when story_id = 2 and id % 9 = 0 then 3 when story_id = 2 and exists (select 1 from articles where story_id = 2 and id % 9 = 0) then 1 else story_id end as story_id, status from articles", "articles"))
def unmerged_stories(v: Views) -> DataFrame:
    """Of two merges only one is undone, and that one is refused where an article has moved on since."""
    rows = v.articles.withColumn("score", F.lit(None).cast("double"))
    stories = cluster.with_centroids(v.stories, rows)
    moved, left, records = cluster.merge_stories(rows, stories, v.spark.createDataFrame(MERGES, "survivor long, merged long"))
    since = rows.where("story_id = 2 and id % 9 = 0").select("id", F.lit(3).cast("long").alias("now"))
    moved = moved.join(since, "id", "left").withColumn("story_id", F.coalesce("now", "story_id")).select(*moved.columns)
    return cluster.unmerge(moved, left, records.where("survivor = 1"), stories)[0].select("id", "story_id", "status")


@query(with_views("select id, case when story_id = 6 then 5 else story_id end as story_id, status from articles", "articles"))
def restored_stories(v: Views) -> DataFrame:
    """The first of two merges is undone and gives its articles back; the second stays."""
    rows = v.articles.withColumn("score", F.lit(None).cast("double"))
    stories = cluster.with_centroids(v.stories, rows)
    moved, left, records = cluster.merge_stories(rows, stories, v.spark.createDataFrame(MERGES, "survivor long, merged long"))
    return cluster.unmerge(moved, left, records.where("survivor = 1"), stories)[0].select("id", "story_id", "status")


@query(with_views("select distinct story_id from articles where mode = 'manual_fixture' and story_id is not null union select distinct story_id from articles where id % 50 = 3 and story_id is not null", "articles"))
def curated_stories(v: Views) -> DataFrame:
    """Stories with a hand-made member."""
    return cluster.curated(v.articles.withColumn("mode", F.when(F.col("id") % 50 == 3, "manual_fixture").otherwise(F.col("mode"))))


@query(with_views("select id, case when id % 3 = 0 then 'A name' else title end as title, case when id % 3 = 0 then 'science' else 'world' end as category from articles", "articles"))
def story_names(v: Views) -> DataFrame:
    """C11: names from answers, all or nothing."""
    raw = F.when(F.col("id") % 3 == 0, F.lit('<think>x</think> ```json\n{"title": " A  name ", "category": "science"}\n```')).when(F.col("id") % 3 == 1, F.lit('{"title": "A name", "category": "gossip"}')).otherwise("no json")
    name = cluster.parsed_name(raw, F.col("title"))
    return v.articles.select("id", name["title"].alias("title"), name["category"].alias("category"))


@query(
    with_views(
        f"""
with {LOOSE}, {CENTROIDS.strip().replace("from articles", "from articles2")},
s as (select l.id, c.story_id, {COS.format("l.embedding", "c.centroid")} as similarity from loose l cross join c join stories t on t.story_id = c.story_id where not (l.id % 4 = 0 and l.id % 10 = c.story_id)),
n as (select *, row_number() over (partition by id order by similarity desc, story_id) as k from s), d as (select id, case when similarity >= 0.2 then 'auto_accepted' else 'pending_review' end as status from n where k = 1 and similarity >= 0.1)
select (select count(*) from loose) as considered, (select count(*) from d where status = 'auto_accepted') as assigned, (select count(*) from d where status = 'pending_review') as held_for_review, 0::bigint as seeded, 0::bigint as stories_created, (select count(*) from loose) - (select count(*) from d) as unclustered
""",
        "articles",
        "stories",
    )
)
def clustering_ledger(v: Views) -> DataFrame:
    """C17: all counts of a pass; what is left seeds stories at the default threshold, which few of the driver's vectors reach."""
    articles, stories, rejected = _candidates(v)
    assigned = staged(cluster.assign_batch(articles, stories, rejected, F.timestamp_seconds(F.lit(START)), Config(similarity=0.2, review_gap=0.1, recency_hours=8760)), "assigned")
    loose = articles.where("embedding is not null and story_id is null").join(assigned, "id", "left_anti")
    return cluster.ledger(articles, assigned, cluster.seed_groups(loose))


@query(f"select label as story_id, list(round(cast(x as double), 4) + 0.0 order by pos) as mean from (select label, pos, {MEAN} as x from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) group by label, pos) group by label")
def vector_means(v: Views) -> DataFrame:
    """G-e: mean vectors."""
    return mean_vector(v.embeddings, "label", "embedding").select(F.col("label").alias("story_id"), F.transform("centroid", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0)).alias("mean"))
