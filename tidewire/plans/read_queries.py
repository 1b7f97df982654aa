"""Queries: timelines, coverage, rollups, read models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import coverage, evidence, timeline
from tidewire.plans.claims_queries import picked_sql
from tidewire.plans.registry import query
from tidewire.plans.views import Views, with_views

POINTS = "pts as (select user_id % 30 as g, event_id as id, user_id as story_id, floor(epoch(ts))::bigint as t from events where event_type <> 'click')"
EVENTS = "evs as (select user_id % 30 as g, floor(epoch(ts))::bigint as t from events where event_type = 'click')"
AXIS = f"""{POINTS}, {EVENTS}, span as (select g, min(t) as from_at, max(t) as to_at, sum(p)::int as points from (select g, t, 1 as p from pts union all select g, t, 0 from evs) group by g),
ax as (select *, case when to_at // 3600 - from_at // 3600 + 1 <= 60 then 3600 when to_at // 86400 - from_at // 86400 + 1 <= 60 then 86400 else 604800 end as size from span),
axes as (select *, from_at // least(size, 86400) * least(size, 86400) as origin, ((to_at - from_at // least(size, 86400) * least(size, 86400)) // size + 1)::int as buckets from ax)"""


def _points(v: Views) -> DataFrame:
    return v.events.where("event_type <> 'click'").select((F.col("user_id") % 30).alias("g"), F.col("event_id").alias("id"), F.col("user_id").alias("story_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def _events(v: Views) -> DataFrame:
    return v.events.where("event_type = 'click'").select((F.col("user_id") % 30).alias("g"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query(with_views(f"with {AXIS} select g, from_at, to_at, points, case size when 3600 then 'hour' when 86400 then 'day' else 'week' end as granularity, origin, buckets from axes"))
def timeline_axes(v: Views) -> DataFrame:
    """span, granularity and origin of each group."""
    return timeline.axis(_points(v), _events(v), ["g"]).drop("size")


@query(with_views(f"with {AXIS}, slots as (select g, origin, size, unnest(range(buckets)) as bucket from axes where points > 0), c as (select p.g, (p.t - origin) // size as bucket, count(*)::int as n from pts p join axes using (g) group by all) select g, bucket::int as bucket, origin + bucket * size as period_start, coalesce(n, 0) as n from slots left join c using (g, bucket)"))
def timeline_volume(v: Views) -> DataFrame:
    """volume with empty buckets; none without points."""
    return timeline.volume(_points(v), timeline.axis(_points(v), _events(v), ["g"]), ["g"])


LANES = "l as (select user_id as story_id, floor(epoch(ts))::bigint as t from events), x as (select min(t) // 86400 * 86400 as origin, ((max(t) - min(t) // 86400 * 86400) // 86400 + 1)::int as buckets from l)"


@query(f"with {LANES}, s as (select story_id, unnest(range(buckets)) as b, origin from (select distinct story_id from l), x), c as (select story_id, (t - origin) // 86400 as b, count(*)::int as n from l, x group by all) select story_id, list(coalesce(n, 0) order by b) as volume from s left join c using (story_id, b) group by story_id")
def timeline_lanes(v: Views) -> DataFrame:
    """a dense lane for each story on a shared axis."""
    points = v.events.select(F.lit(0).alias("g"), F.col("event_id").alias("id"), F.col("user_id").alias("story_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    axis = timeline.axis(points, points.where("false").select("g", "at"), ["g"])
    return timeline.lanes(points, axis).select("story_id", "volume")


@query("select user_id as story_id, 'evidence_frozen' as event, floor(epoch(ts))::bigint as at, null as lens from events where event_type = 'view' union all select user_id, 'analysis_completed', floor(epoch(ts))::bigint, case when event_id % 2 = 0 then 'student' else 'investor' end from events where event_type = 'purchase' and event_id % 3 = 0")
def timeline_events(v: Views) -> DataFrame:
    """freezes and completed runs as one stream."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    freezes = v.events.where("event_type = 'view'").select(F.col("user_id").alias("story_id"), at.alias("frozen_at"))
    runs = v.events.where("event_type = 'purchase'").select(F.col("user_id").alias("story_id"), F.when(F.col("event_id") % 2 == 0, "student").otherwise("investor").alias("lens"), at.alias("completed_at"), F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return timeline.event_stream(freezes, runs)


@query(with_views("select s.story_id, s.title, s.category, coalesce(n, 0)::int as article_count from stories s left join (select story_id, count(*) as n from articles where status = 'auto_accepted' group by 1) c using (story_id)", "articles", "stories"))
def story_list(v: Views) -> DataFrame:
    """stories with accepted counts."""
    return coverage.story_list(v.stories, v.articles).select("story_id", "title", "category", "article_count")


@query(with_views("select id, at_s from articles where story_id = 3 and status = 'auto_accepted'", "articles"))
def story_detail(v: Views) -> DataFrame:
    """a story's accepted members."""
    return coverage.story_detail(v.articles, F.lit(3)).select("id", "at_s")


@query(
    with_views(
        """
with b as (select a.story_id, case p.leaning when 'left' then 'left' when 'lean_left' then 'left' when 'center' then 'centre' when 'lean_right' then 'right' when 'right' then 'right' end as band from articles a join publishers p using (publisher_id) where a.status = 'auto_accepted' and (a.story_id <> 2 or p.leaning = 'left')),
c as (select story_id, count(*) filter (where band = 'left')::int as left_n, count(*) filter (where band = 'centre')::int as centre_n, count(*) filter (where band = 'right')::int as right_n, count(*) filter (where band is null)::int as unrated_n, count(*)::int as total from b group by 1)
select *, case when left_n + centre_n + right_n >= 2 and (left_n + centre_n + right_n) / total >= 0.5 and greatest(left_n, centre_n, right_n) / (left_n + centre_n + right_n) >= 0.8 then case when left_n = greatest(left_n, centre_n, right_n) then 'left' when centre_n = greatest(left_n, centre_n, right_n) then null else 'right' end end as blindspot from c
""",
        "articles",
        "publishers",
    )
)
def coverage_spectra(v: Views) -> DataFrame:
    """F8: spectra and blindspots."""
    rows = v.articles.where("status = 'auto_accepted'").join(v.publishers, "publisher_id").where("story_id <> 2 or leaning = 'left'")
    return coverage.spectrum(rows)


RATED = ", ".join(f"('{d}', '{x}')" for d, x in coverage.LEANINGS.items())


@query(
    f"""
with h as (select page_id, case page_id % 6 when 0 then 'edition.cnn.com' when 1 then 'www.bbc.co.uk' when 2 then 'notfoxnews.com' when 3 then 'news.bbc.com' when 4 then 'foxnews.com' else 'site.example' end as domain from pages), r(d, leaning) as (values {RATED})
select page_id, arg_max(r.leaning, length(d)) as leaning from h left join r on regexp_replace(h.domain, '^www\\.', '') = d or ends_with(h.domain, '.' || d) group by page_id
"""
)
def publisher_leanings(v: Views) -> DataFrame:
    """ratings by the longest rated domain."""
    names = ["edition.cnn.com", "www.bbc.co.uk", "notfoxnews.com", "news.bbc.com", "foxnews.com", "site.example"]
    domain = F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 6).cast("int"))
    return coverage.with_leaning(v.pages.select("page_id", domain.alias("domain"))).select("page_id", "leaning")


@query(with_views("select publisher_id, case when length(publisher_id) % 2 = 1 and leaning is not null then leaning end as rating from publishers", "publishers"))
def public_leanings(v: Views) -> DataFrame:
    """ratings show with a known source only."""
    source = F.when(F.length("publisher_id") % 2 == 1, "ratings").otherwise("hearsay")
    return v.publishers.select("publisher_id", coverage.public_leaning(F.col("leaning"), source, ["ratings"])["rating"].alias("rating"))


@query(with_views("with c(category) as (values ('politics'), ('business'), ('technology'), ('science'), ('health'), ('world'), ('sports'), ('entertainment')), n as (select story_id, count(*) as n from articles where status = 'auto_accepted' group by 1) select c.category, count(distinct s.story_id)::int as stories, coalesce(sum(n.n), 0)::int as articles from c left join stories s using (category) left join n on n.story_id = s.story_id group by c.category", "articles", "stories"))
def sector_rollup(v: Views) -> DataFrame:
    """stories and accepted articles of every category."""
    return coverage.sector_rollup(v.stories, v.articles)


@query("select * from (values ('student'), ('investor'), ('admin')) r(role) left join (select case when c_custkey % 3 = 0 then 'student' else 'investor' end as role, count(*)::int as n from customer group by 1) c using (role)".replace("select *", "select role, coalesce(n, 0)::int as n", 1))
def role_counts(v: Views) -> DataFrame:
    """users by role, zeros too."""
    return coverage.dense_counts(v.customer.select(F.when(F.col("c_custkey") % 3 == 0, "student").otherwise("investor").alias("role")), "role")


@query(with_views("select story_id, count(distinct publisher_id)::int as publishers from articles where status = 'auto_accepted' group by story_id having count(distinct publisher_id) >= 2", "articles"))
def comparable_candidates(v: Views) -> DataFrame:
    """F13, G-c: stories with several publishers."""
    return coverage.comparable_candidates(v.articles)


@query(
    with_views(
        f"""
{picked_sql(0.97)},
a2 as (select story_id from articles where status = 'auto_accepted' group by story_id having count(distinct publisher_id) >= 2), p2 as (select story_id from picked group by story_id having count(distinct publisher_id) >= 2)
select story_id, title from stories where story_id in (select story_id from a2) and story_id in (select story_id from p2) order by last_at desc, title, story_id limit 10
""",
        "articles",
        "stories",
    )
)
def comparable_stories(v: Views) -> DataFrame:
    """the latest comparable stories, by their selected evidence."""
    picked = evidence.select_evidence(evidence.ranked_candidates(v.articles)).join(v.articles.select("id", "publisher_id"), "id")
    return coverage.comparable_stories(v.articles, picked, v.stories).select("story_id", "title")


@query(with_views("select p.publisher_id, count(a.id)::int as article_count from publishers p left join articles a on a.publisher_id = p.publisher_id group by 1", "articles", "publishers"))
def publisher_register(v: Views) -> DataFrame:
    """F14, G-g: publishers with their article counts."""
    return coverage.publisher_register(v.publishers, v.articles).select("publisher_id", "article_count")


@query("select event_type as ledger, event_id as run_id from (select *, row_number() over (partition by event_type order by ts desc, event_id) as k from events) where k <= 20")
def recent_runs(v: Views) -> DataFrame:
    """the latest runs of each ledger."""
    return coverage.recent_runs(v.events.select(F.col("event_type").alias("ledger"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))).select("ledger", "run_id")


@query("select c_custkey as id, c_name from customer order by c_acctbal desc, c_custkey limit 10 offset 20")
def list_page(v: Views) -> DataFrame:
    """L1, L2, L3: the third page of a sorted list."""
    asked = coverage.parse_list_query({"page": "3", "pageSize": "10", "sort": "c_acctbal:desc"}, ["c_acctbal"])
    return coverage.paged(v.customer.withColumnRenamed("c_custkey", "id"), asked).select("id", "c_name")


@query("select c_custkey as id from customer where c_custkey % 3 = 0 and c_name ilike '%0000001%'")
def user_search(v: Views) -> DataFrame:
    """Users by role and a part of their address."""
    users = v.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "student").otherwise("investor").alias("role"), F.col("c_name").alias("email"), F.lit(True).alias("active"), F.col("c_acctbal").alias("created_at"))
    return coverage.user_search(users, "student", True, "0000001").select("id")


@query(with_views("with r as (select event_id as run_id, user_id % 12 as story_id, case when event_id % 2 = 0 then 'student' else 'investor' end as lens, ts from events where event_type = 'purchase'), k as (select *, row_number() over (partition by story_id, lens order by ts desc, run_id desc) as k from r) select story_id, lens, run_id from k where k = 1 and story_id in (select story_id from articles where status = 'auto_accepted')", "articles"))
def current_analyses(v: Views) -> DataFrame:
    """The latest completed run of each story and lens."""
    runs = v.events.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 12).alias("story_id"), F.when(F.col("event_id") % 2 == 0, "student").otherwise("investor").alias("lens"), F.col("ts").alias("completed_at"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"))
    return coverage.current_analysis(runs, v.articles)


@query("select event_id as run_id, 'investor' as role, case when event_id % 3 = 0 then 'not_found' when event_type <> 'purchase' then 'not_completed' when event_id % 2 = 0 then 'wrong_lens' end as refusal from events")
def reader_gates(v: Views) -> DataFrame:
    """K2: why a run is not shown."""
    runs = v.events.where("event_id % 3 <> 0").select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.when(F.col("event_id") % 2 == 0, "student_context").otherwise("investor_implication").alias("lens"))
    return coverage.reader_gate(runs, v.events.select(F.col("event_id").alias("run_id"), F.lit("investor").alias("role")))


@query("select o_custkey as brief_id, least(count(*), 1000)::int as article_count from orders group by 1 union all select c_custkey, 0 from customer where c_custkey not in (select o_custkey from orders)")
def brief_list(v: Views) -> DataFrame:
    """K3: briefs with their article counts."""
    return coverage.brief_list(v.customer.select(F.col("c_custkey").alias("brief_id")), v.orders.select(F.col("o_custkey").alias("brief_id"))).select("brief_id", "article_count")


@query("with e as (select o_custkey as b, o_orderkey as a, o_orderkey % 50 <> 0 as p from orders), h as (select b, a from e where a % 3 = 0) select e.b as brief_id, count(*) filter (where h.a is null)::int as missing, case when not bool_and(p) then 'no_provenance' when count(h.a) + count(*) filter (where h.a is null) > 12 then 'over_capacity' else 'attached' end as verdict from e left join h on e.b = h.b and e.a = h.a group by e.b")
def brief_attachments(v: Views) -> DataFrame:
    """Analyses saved to briefs of 12 articles."""
    rows = v.orders.select(F.col("o_custkey").alias("brief_id"), F.col("o_orderkey").alias("article_id"), (F.col("o_orderkey") % 50 != 0).alias("has_provenance"))
    briefs = v.customer.select(F.col("c_custkey").alias("brief_id"), F.lit(12).alias("capacity"))
    return coverage.attach_analysis(briefs, rows.where("article_id % 3 = 0").select("brief_id", "article_id"), rows)


@query(with_views("select id as article_id, case when status is distinct from 'auto_accepted' then 'not_a_member' when id % 5 = 0 then 'already_attached' when id % 2 = 0 then 'full' else 'attached' end as verdict from articles", "articles"))
def brief_single(v: Views) -> DataFrame:
    """K5: single articles attached."""
    briefs = v.articles.agg(F.count("*").cast("int").alias("n")).selectExpr("inline(array(struct(0L as brief_id, 3 as capacity), struct(1L as brief_id, n as capacity)))")
    attached = v.articles.where("id % 5 = 0").select((F.col("id") % 2).alias("brief_id"), F.col("id").alias("article_id"))
    return coverage.attach_article(briefs, attached, v.articles.select((F.col("id") % 2).alias("brief_id"), F.col("id").alias("article_id")), v.articles).select("article_id", "verdict")


@query("select survivor, merged, k::int as rank, n::int as total from (select o_custkey as survivor, o_orderkey as merged, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders) where k <= 10")
def merge_history(v: Views) -> DataFrame:
    """K7: the latest merges of each survivor."""
    return coverage.merge_history(v.orders.select(F.col("o_custkey").alias("survivor"), F.col("o_orderkey").alias("merged"), F.col("o_orderdate").alias("merged_at"))).select("survivor", "merged", "rank", "total")


@query("with i as (select distinct user_id as owner, case when event_id % 2 = 0 then 'ticker' else 'sector' end as kind, case when event_id % 2 = 0 then case event_id % 3 when 0 then 'AAPL' when 1 then 'MSFT' else null end else case event_id % 3 when 0 then 'world' when 1 then 'science' else null end end as value from events) select owner, kind, value, case when kind = 'sector' then 'none' when value = 'AAPL' then 'ready' else 'unavailable' end as status from i where value is not null")
def watchlists(v: Views) -> DataFrame:
    """Watched tickers and sectors."""
    e = F.col("event_id")
    ticker = F.when(e % 3 == 0, " aapl").when(e % 3 == 1, "msft").otherwise("not a ticker")
    sector = F.when(e % 3 == 0, "world").when(e % 3 == 1, "science").otherwise("gossip")
    items = v.events.select(F.col("user_id").alias("owner"), F.when(e % 2 == 0, "ticker").otherwise("sector").alias("kind"), F.when(e % 2 == 0, ticker).otherwise(sector).alias("value"))
    return coverage.watchlist(items, v.spark.createDataFrame([("AAPL", 1.0)], "ticker string, price double")).select("owner", "kind", "value", "status")
