"""Queries: text and URL functions, feed readers, ingestion."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidewire.functions.text import content_hash, excerpt, fold, normalize_title, strip_html
from tidewire.functions.urls import canonical_url, publisher_domain
from tidewire.operators import ingest
from tidewire.plans.registry import query
from tidewire.plans.views import Views, with_views
from tidewire.sources import feeds, seed
from tidewire.sources.providers import embedded, mock_answer, mock_embeddings

TRACKERS = "'fbclid','gclid','igshid','mc_cid','mc_eid','cmpid','ncid','ito','sh','smid'"


@query(
    f"""
with u as (select page_id, trim(url) as url from pages),
p as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) as rest from u),
s as (select page_id, scheme, lower(regexp_extract(rest, '^([^/?]*)', 1)) as host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path, regexp_extract(rest, '\\?(.*)$', 1) as q from p),
k as (select page_id, pair, i, split_part(pair, '=', 1) as name from (select page_id, unnest(string_split(q, '&')) as pair, unnest(range(len(string_split(q, '&')))) as i from s)
  where pair <> '' and lower(split_part(pair, '=', 1)) not in ({TRACKERS}) and not starts_with(lower(split_part(pair, '=', 1)), 'utm_') and not starts_with(lower(split_part(pair, '=', 1)), 'at_')),
g as (select page_id, string_agg(pair, '&' order by name, i) as q from k group by page_id)
select s.page_id, case when scheme in ('http', 'https') and regexp_matches(host, '^[^\\s@]+$') then scheme || '://' || host || case when path in ('', '/') then '/' when regexp_replace(path, '/+$', '') = '' then '/' else regexp_replace(path, '/+$', '') end || coalesce('?' || g.q, '') end as canonical,
  regexp_replace(host, '^www\\.', '') as domain
from s left join g on s.page_id = g.page_id
"""
)
def canonical_urls(v: Views) -> DataFrame:
    """B1, B2: identity and publisher domain of every page."""
    url = canonical_url(F.col("url"))
    return v.pages.select("page_id", url.alias("canonical"), publisher_domain(url).alias("domain"))


@query(
    r"""
select 'part' as kind, p_partkey as key, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) as folded from part
union all select 'title', doc_id, trim(regexp_replace(lower(trim(split_part(text, '.', 1))), '[^\p{L}\p{N}]+', ' ', 'g')) from documents
"""
)
def folded_names(v: Views) -> DataFrame:
    """Folded names of parts and titles."""
    return v.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), fold(F.col("p_name")).alias("folded")).union(v.articles.select(F.lit("title"), "id", normalize_title(F.col("title"))))


@query(
    r"""
with c as (select doc_id, replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[', '('), ']', ')') as t from documents),
h as (select doc_id, t, substr(t, 1, 300) as head from c),
s as (select doc_id, t, head, strpos(reverse(head), ' ') as back from h)
select doc_id, case when length(t) <= 300 then t else case when back > 0 and 300 - back > 100 then substr(head, 1, 300 - back) else head end || '…' end as excerpt from s
"""
)
def excerpts(v: Views) -> DataFrame:
    """Excerpts of 300 characters."""
    return v.documents.select("doc_id", excerpt(F.col("text"), 300).alias("excerpt"))


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hashes(v: Views) -> DataFrame:
    """Content hashes."""
    return v.documents.select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def _decoded(text: str) -> str:
    """SQL of the references in the given pages, decoded once, and of the white space."""
    return rf"""trim(regexp_replace(replace(replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    rf"""
with p as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') as bare, regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1) as inner_html from pages),
t as (select page_id, {_decoded("regexp_replace(bare, '<[^>]*>', ' ', 'g')")} as plain, {_decoded("regexp_replace(regexp_replace(inner_html, '</?(?:p|br|h1|ul|li|div)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')")} as main from p)
select page_id, plain, case when length(main) >= 200 then main end as main from t
"""
)
def page_texts(v: Views) -> DataFrame:
    """Plain text and running text of every page; the twin takes the text of the article element, which the tree has to find."""
    return v.pages.select("page_id", strip_html(F.col("html")).alias("plain"), feeds.main_text(F.col("html"), 200).alias("main"))


def _gkg_lines(v: Views) -> DataFrame:
    """Annotation windows made of orders: parts as persons, part types as themes."""
    named = v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("p_name", F.lit(","), (F.col("l_linenumber") * 7).cast("string")))), ";").alias("persons"),
        F.array_join(F.array_sort(F.collect_list(F.concat("p_type", F.lit(","), (F.col("l_linenumber") * 11).cast("string")))), ";").alias("themes"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("4#"), "p_type", F.lit("#US##"), F.lit("x#"), (F.col("l_linenumber") * 20).cast("string"), F.lit("#"), (F.col("l_linenumber") * 10).cast("string"), F.lit("#F1#"), (F.col("l_linenumber") * 3).cast("string")))), ";").alias("places"),
    )
    rows = v.orders.join(named, F.col("o_orderkey") == F.col("l_orderkey"))
    parts = [F.lit("") for _ in range(feeds.FIELDS)]
    for name, value in (("record", F.col("o_orderkey").cast("string")), ("seen", F.date_format("o_orderdate", "yyyyMMddHHmmss")), ("domain", F.lit("News.Example")), ("url", F.concat(F.lit("https://news.example/"), F.col("o_orderkey").cast("string"))), ("themes", F.col("themes")), ("locations", F.col("places")), ("persons", F.col("persons")), ("tone", F.concat((F.col("o_orderkey") % 7 - 3).cast("string"), F.lit(",1,2"))), ("extras", F.concat(F.lit("<PAGE_TITLE>"), F.col("o_orderpriority"), F.lit("</PAGE_TITLE>")))):
        parts[feeds.GKG[name]] = value
    return rows.select(F.array_join(F.array(*parts), "\t").alias("value"))


@query(
    """
select cast(o_orderkey as varchar) as record, false as malformed, epoch(o_orderdate)::bigint as seen, 'news.example' as domain, o_orderpriority as title, cast(o_orderkey % 7 - 3 as double) as tone
from orders where o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey)
"""
)
def gkg_scalars(v: Views) -> DataFrame:
    """Scalar fields of annotation windows."""
    return feeds.gkg_rows(_gkg_lines(v)).select("record", "malformed", F.unix_timestamp("seen_at").alias("seen"), "domain", "title", "tone")


@query(
    """
select record, kind, surface_name, char_offset, latitude from (
select cast(l_orderkey as varchar) as record, 'person' as kind, p_name as surface_name, l_linenumber * 7 as char_offset, cast(null as double) as latitude from lineitem join part on l_partkey = p_partkey
union all select cast(l_orderkey as varchar), 'theme', p_type, l_linenumber * 11, null from lineitem join part on l_partkey = p_partkey
union all select cast(l_orderkey as varchar), 'location', p_type, l_linenumber * 3, cast(l_linenumber * 20 as double) from lineitem join part on l_partkey = p_partkey where l_linenumber * 20 <= 90)
where cast(record as bigint) in (select o_orderkey from orders)
"""
)
def gkg_annotations(v: Views) -> DataFrame:
    """Occurrences of names, themes and places; places off the globe are dropped."""
    found = feeds.annotations(feeds.gkg_rows(_gkg_lines(v)))
    return found.select("record", "kind", "surface_name", "char_offset", F.col("location_detail.latitude").alias("latitude"))


@query(
    """
select page_id, n, case when n = 0 then url else url || '&item=' || cast(n as varchar) end as link, 'Item ' || cast(page_id as varchar) || ' & more' as title from pages, (select unnest(range(2)) as n)
"""
)
def rss_feed_items(v: Views) -> DataFrame:
    """A1: items of RSS payloads."""
    item = lambda n: F.concat(F.lit("<item><title>Item "), F.col("page_id").cast("string"), F.lit(" &amp; more</title><link>"), F.regexp_replace("url", "&", "&amp;"), F.lit(f"&amp;item={n}" if n else ""), F.lit("</link><description>text</description></item>"))
    xml = F.concat(F.lit("<rss version='2.0'><channel><title>Feed</title>"), item(0), item(1), F.lit("</channel></rss>"))
    return feeds.rss_items(v.pages.select("page_id", xml.alias("xml"))).select("page_id", F.col("position").cast("long").alias("n"), "link", "title")


@query(
    """
select case when page_id % 10 = 0 then 'articles is not a list' when page_id % 10 = 1 then 'empty body' end as failure, page_id, case when page_id % 10 > 2 then url end as url, case when page_id % 10 > 2 then 1704067200 end as seen
from pages where page_id % 10 <> 2
"""
)
def doc_articles(v: Views) -> DataFrame:
    """A10: article lists, with malformed bodies and one without articles."""
    record = F.to_json(F.struct(F.array(F.struct("url", F.lit("20240101T000000Z").alias("seendate"))).alias("articles")))
    body = F.when(F.col("page_id") % 10 == 0, '{"articles": 3}').when(F.col("page_id") % 10 == 1, " ").when(F.col("page_id") % 10 == 2, "{}").otherwise(record)
    return feeds.article_list(v.pages.select("page_id", body.alias("body"))).select("failure", "page_id", "url", F.unix_timestamp("seen_at").alias("seen"))


@query(
    with_views(
        """
with recursive seeds as (select distinct title, list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(title, ''), lambda c: unicode(c)::ubigint)), lambda h, u: (xor(h, u) * 16777619::ubigint) & 4294967295::ubigint) as h from articles where title <> '' union all select '', 2166136261::ubigint),
states(title, k, s) as (select title, 0, case when h = 0 then 1::ubigint else h end from seeds union all select title, k + 1, xor(b, (b << 5) & 4294967295::ubigint) from (select title, k, xor(a, a >> 17) as b from (select title, k, xor(s, (s << 13) & 4294967295::ubigint) as a from states where k < 8))),
raw as (select title, list(s::double / 4294967295.0 * 2 - 1 order by k) as v from states where k > 0 group by title)
select a.id, list_transform(raw.v, lambda x: round(cast(cast(x / sqrt(list_sum(list_transform(raw.v, lambda y: y * y))) as float) as double), 5) + 0.0) as vector from articles a join raw using (title)
""",
        "articles",
    )
)
def mock_vectors(v: Views) -> DataFrame:
    """Vectors of titles by the deterministic provider, eight dimensions."""
    vector = embedded(F.col("title"), lambda texts: mock_embeddings(texts, 8), 8)
    return v.articles.select("id", F.transform(vector, lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)).alias("vector"))


@query(
    with_views(
        """
with a as (select id, title, published, dom, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) as key from (select id, title, cast(at_s // 864000 as bigint) as published, case when id % 3 = 0 then 'news.' when id % 3 = 1 then '' else 'x' end || 'agency.example' as dom from articles))
select 'https://x.example/' || cast(n.id as varchar) as url, min('https://x.example/' || cast(h.id as varchar)) as duplicate_of
from a n join a h on n.published = h.published and n.key = h.key and n.key <> '' and n.id <> h.id and (n.dom = h.dom or ends_with(n.dom, '.' || h.dom) or ends_with(h.dom, '.' || n.dom))
where n.id % 2 = 1 and h.id % 2 = 0 group by n.id
""",
        "articles",
    )
)
def duplicates(v: Views) -> DataFrame:
    """Incoming articles that repeat a held title on a day, from a related domain."""
    day = F.timestamp_seconds(F.floor(F.col("at_s") / 864000) * 86400)
    domain = F.concat(F.when(F.col("id") % 3 == 0, "news.").when(F.col("id") % 3 == 1, "").otherwise("x"), F.lit("agency.example"))
    rows = v.articles.select("id", F.concat(F.lit("https://x.example/"), F.col("id").cast("string")).alias("url"), domain.alias("domain"), "title", day.alias("published_at"))
    return ingest.duplicate_pairs(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))


RANK = "case mode when 'metadata_only' then 0 when 'feed_excerpt' then 1 when 'api_content' then 2 when 'licensed_full_text' then 3 end"


@query(
    with_views(
        f"""
with r as (select *, {RANK} as rank from sightings),
f as (select url_key, arg_min(title, seq) as t0, arg_min(domain, seq) as domain, arg_min(mode, seq) as m0, arg_min(body, seq) as b0, arg_min(rank, seq) as r0, max(rank) as r1, arg_min(tone, seq) filter (where tone is not null) as tone, arg_min(title, seq) filter (where title <> domain) as good, count(*)::int as sightings from r group by url_key),
b as (select url_key, mode, body from (select *, row_number() over (partition by url_key order by rank desc, seq) as n from r) where n = 1)
select 'u' || cast(f.url_key as varchar) as url, case when t0 = domain then coalesce(good, t0) else t0 end as title, domain, case when r1 > r0 then b.mode else m0 end as mode, case when r1 > r0 then b.body else b0 end as body, tone, r1 > r0 as climbed, sightings
from f join b on f.url_key = b.url_key
""",
        "sightings",
    )
)
def enrichment(v: Views) -> DataFrame:
    """Sightings of each URL reconciled up the ladder."""
    return ingest.reconciled(v.sightings.withColumn("url", F.concat(F.lit("u"), F.col("url_key").cast("string"))))


@query(
    f"""
with e as (select user_id, event_id, case event_type when 'click' then 'metadata_only' when 'view' then 'feed_excerpt' when 'purchase' then 'licensed_full_text' else 'api_content' end as mode, case when event_id % 3 = 0 then null else value end as tone from events),
now as (select user_id, case when min(event_id) % 10 = 0 then 'no title' end as failure, max({RANK}) as rank, max(tone) as tone from e where event_id % 4 <> 0 group by user_id),
held as (select user_id, arg_min({RANK}, event_id) as rank, arg_min(coalesce(tone, -1e9), event_id) as tone from e where event_id % 4 = 0 group by user_id)
select cast(now.user_id as varchar) as url, case when failure is not null then 'failed' when held.user_id is null then 'inserted' when now.rank > held.rank or (held.tone = -1e9 and now.tone is not null) or now.user_id % 5 = 0 then 'enriched' else 'duplicate' end as outcome
from now left join held on now.user_id = held.user_id
"""
)
def ingest_outcomes(v: Views) -> DataFrame:
    """Outcomes of incoming URLs."""
    rows = v.sightings.withColumn("url", F.col("url_key").cast("string"))
    first = rows.where("seq % 4 <> 0").groupBy("url").agg(F.min("seq").alias("s0"))
    incoming = rows.where("seq % 4 <> 0").join(first, "url").withColumn("failure", F.when(F.col("s0") % 10 == 0, "no title"))
    held = rows.where("seq % 4 = 0").groupBy("url").agg(F.min_by("mode", "seq").alias("mode"), F.min_by("tone", "seq").alias("tone"))
    return ingest.outcomes(incoming, held, rows.where("url_key % 5 = 0"))


@query(
    """
select cast(user_id % 20 as bigint) as run_id, count(*)::int as discovered, count(*) filter (where event_type = 'click')::int as inserted, count(*) filter (where event_type = 'view')::int as enriched, count(*) filter (where event_type = 'purchase')::int as duplicate, 0 as rejected_by_policy,
  count(*) filter (where event_type not in ('click', 'view', 'purchase'))::int as failed, coalesce(list_sort(list(distinct 'bad ' || cast(event_id % 9 as varchar)) filter (where event_type not in ('click', 'view', 'purchase')))[1:5], []) as messages
from events group by user_id % 20
"""
)
def ingestion_ledger(v: Views) -> DataFrame:
    """Counts and messages of each run."""
    outcome = F.when(F.col("event_type") == "click", "inserted").when(F.col("event_type") == "view", "enriched").when(F.col("event_type") == "purchase", "duplicate").otherwise("failed")
    failure = F.when(outcome == "failed", F.concat(F.lit("bad "), (F.col("event_id") % 9).cast("string")))
    return ingest.run_ledger(v.events.select((F.col("user_id") % 20).alias("run_id"), outcome.alias("outcome"), failure.alias("failure")))


@query(
    """
with c as (select event_id, floor(epoch(ts))::bigint as c, floor(epoch(ts))::bigint // 900 * 900 + (event_id % 12) * 900 as now from events),
m as (select event_id, c // 900 * 900 as snapped, now, cast((now - c // 900 * 900) / 900 - 1 as int) as missed from c)
select event_id, case when missed < 0 then 0 when missed > 8 then 1 else missed + 1 end as windows, case when missed > 8 then missed else 0 end as skipped from m
"""
)
def catch_up_plan(v: Views) -> DataFrame:
    """Windows to load after a cursor."""
    current = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900 + (F.col("event_id") % 12) * 900)
    planned = ingest.catch_up(v.events.select("event_id", F.col("ts").cast("timestamp").alias("cursor"), current.alias("current")))
    return planned.select("event_id", F.size("windows").alias("windows"), "skipped")


@query(
    """
select user_id % 7 as connector_id, strftime(max(to_timestamp(floor(epoch(ts))::bigint // 900 * 900) at time zone 'UTC'), '%Y%m%d%H%M%S') as cursor from events where event_type <> 'click' and event_id % 3 <> 0 group by user_id % 7
"""
)
def connector_cursors(v: Views) -> DataFrame:
    """The latest good cursor of each connector."""
    on_grid = F.date_format(F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900), "yyyyMMddHHmmss")
    runs = v.events.select((F.col("user_id") % 7).alias("connector_id"), F.when(F.col("event_id") % 3 == 0, "99999999999999").otherwise(on_grid).alias("cursor"), F.when(F.col("event_type") == "click", "failed").otherwise("succeeded").alias("status"))
    return ingest.read_cursor(runs)


@query(
    """
with w as (select user_id as run_id, event_id as stamp, event_type = 'click' as failed from events), s as (select *, min(stamp) filter (where failed) over (partition by run_id) as stop from w)
select run_id, max(stamp) filter (where stop is null or stamp < stop) as cursor, count(*) filter (where not failed)::int as loaded, case when bool_and(failed) then 'failed' else 'succeeded' end as status from s group by run_id
"""
)
def cursor_blocking(v: Views) -> DataFrame:
    """A cursor stops before the first failed window."""
    return ingest.advanced_cursor(v.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("stamp"), (F.col("event_type") == "click").alias("failed")))


@query(
    with_views(
        """
select id from articles where not (at_s < (select max(at_s) from articles) - 7 * 86400 and mode = 'metadata_only' and id % 3 in (0, 1) and story_id is null and id % 9 <> 0)
""",
        "articles",
    )
)
def retention(v: Views) -> DataFrame:
    """What stays after pruning, on the day of the last article."""
    now = v.articles.agg(F.max("published_at")).first()[0]
    rows = v.articles.select("id", "mode", "story_id", F.col("published_at").alias("created_at"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("connector_id"))
    connectors = v.spark.createDataFrame([(1, "gdelt_gkg"), (2, "rss")], "connector_id long, kind string")
    briefs = v.articles.where("id % 9 = 0").select(F.col("id").alias("article_id"))
    return ingest.pruned(rows, connectors, briefs, F.lit(now)).select("id")


@query(with_views(f"select publisher_id, arg_min(mode, {RANK}) as weakest_mode from articles group by publisher_id", "articles"))
def weakest_modes(v: Views) -> DataFrame:
    """The weakest text mode of each publisher."""
    return ingest.weakest_mode(v.articles, "publisher_id")


@query(
    """
select distinct lower(source) || '.example' as domain from documents where cast(substr(source, 4) as int) >= 12
"""
)
def publishers_to_create(v: Views) -> DataFrame:
    """Domains without a publisher."""
    held = v.publishers.where("cast(substr(publisher_id, 4) as int) < 12")
    return ingest.new_publishers(v.articles.select(F.concat(F.lower("publisher_id"), F.lit(".example")).alias("domain")), held)


@query(with_views("select distinct article_id, kind, char_offset, surface_name from annotations where char_offset % 2 = 1", "annotations"))
def annotation_staging(v: Views) -> DataFrame:
    """Occurrences that are not held yet."""
    rows = v.annotations
    return ingest.staged_annotations(rows.unionByName(rows), rows.where("char_offset % 2 = 0")).select("article_id", "kind", "char_offset", "surface_name")


@query(
    with_views(
        """
select a.id from articles a join publishers p on a.publisher_id = p.publisher_id where a.mode = 'feed_excerpt' and a.id % 2 = 0 and p.terms_class = 'licensed' and a.id % 3 <> 0 order by a.at_s desc, a.id limit 21
""",
        "articles",
        "publishers",
    )
)
def extraction_candidates(v: Views) -> DataFrame:
    """The newest feed excerpts whose pages may be read."""
    rows = v.articles.select("id", "mode", "publisher_id", "published_at", (F.col("id") % 2).alias("connector_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).alias("extraction_attempted_at"))
    connectors = v.spark.createDataFrame([(0, "rss", False), (1, "rss", True)], "connector_id long, kind string, feed_provides_full_text boolean")
    return ingest.extraction_backlog(rows, connectors, v.publishers).select("id")


@query(
    """
select page_id, case when page_id % 11 = 0 then 'fetch failed' when page_id % 7 = 0 then 'no title' when page_id % 5 = 0 then 'bad url' when page_id % 4 = 0 then 'no date' when page_id % 3 = 0 then 'no text' when page_id % 2 = 0 then 'source and document unrelated' end as failure from pages
"""
)
def item_failures(v: Views) -> DataFrame:
    """The first failure of incoming items."""
    p = F.col("page_id")
    items = v.pages.select(
        "page_id", F.when(p % 7 == 0, "").otherwise("Title").alias("title"), F.when(p % 5 == 0, "ftp://x").otherwise(F.lit("https://news.example/a")).alias("link"), F.when(p % 4 != 0, F.current_timestamp()).alias("published_at"),
        F.lit("feed_excerpt").alias("mode"), F.when(p % 3 != 0, "text").alias("body"), F.when(p % 2 == 0, "other.example").alias("source_domain"), F.when(p % 11 == 0, "fetch failed").alias("failure"),
    )
    return ingest.validated(items).select("page_id", "failure")


@query("""select doc_id, '{"claims":[{"text":"The reports agree on the main event.","claim_type":"consensus","citations":["A' || cast(doc_id as varchar) || '"]},{"text":"The event matters to this reader.","claim_type":"student_context","citations":["A' || cast(doc_id as varchar) || '"]}]}' as answer from documents""")
def mock_answers(v: Views) -> DataFrame:
    """Answers of the deterministic provider."""
    return v.documents.select("doc_id", mock_answer(F.array(F.concat(F.lit("A"), F.col("doc_id").cast("string"))), F.lit("student_context")).alias("answer"))


@F.pandas_udf(BinaryType())
def _zipped(ids: pd.Series) -> pd.Series:
    """A window of two lines for each id; two files where the id ends in 1, no archive where it ends in 0."""

    def one(n: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in ["a.csv", "b.csv"][: 1 + (n % 10 == 1)]:
                z.writestr(name, f"{n}\tfirst\n{n}\tsecond\n")
        return out.getvalue() if n % 10 else b"plain bytes"

    return ids.map(one)


@query(
    """
select page_id, case page_id % 10 when 0 then 'not an archive' when 1 then 'archive out of bounds' when 2 then 'archive out of bounds' end as failure, case when page_id % 10 > 2 then cast(page_id as varchar) || chr(9) || line end as value
from pages, (values ('first'), ('second')) l(line) where page_id % 10 > 2 or line = 'first'
"""
)
def archive_windows(v: Views) -> DataFrame:
    """Lines of zipped windows; some are no archive, some hold two files, some are too long."""
    length = F.when(F.col("page_id") % 10 == 2, feeds.ARCHIVE_BYTES + 1).otherwise(F.length("content"))
    files = v.pages.select("page_id", _zipped("page_id").alias("content")).select(F.col("page_id").cast("string").alias("path"), length.alias("length"), "content")
    return feeds.archive_lines(files).select(F.col("path").cast("long").alias("page_id"), "failure", "value")


@query(
    """
select page_id, case page_id % 4 when 0 then 'https://api.example/doc?query=q' || page_id || '&mode=artlist&format=json&maxrecords=250' when 1 then 'https://api.example/doc?mode=artlist&query=q' || page_id || '&sort=new&maxrecords=250&format=json' end as request
from pages
"""
)
def list_requests(v: Views) -> DataFrame:
    """Requests for article lists; none without a query."""
    n = F.col("page_id").cast("string")
    tail = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("query=q"), n)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("mode=x&query=q"), n, F.lit("&sort=new&mode=y&maxrecords=9#top"))).when(F.col("page_id") % 4 == 2, "query=&format=csv").otherwise("sort=new")
    return v.pages.select("page_id", feeds.list_requests(F.concat(F.lit("https://api.example/doc?"), tail)).alias("request"))


@query("select page_id, case when page_id % 3 > 0 and page_id % 5 > 0 then 'http://Data.example/' || page_id || '.gkg.csv.zip' end as archive from pages")
def window_archives(v: Views) -> DataFrame:
    """The archive that each listing names last; none of another host."""
    n = F.col("page_id").cast("string")
    host = F.when(F.col("page_id") % 3 == 0, "http://other.example/").otherwise("http://Data.example/")
    line = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("12 ab "), host, n, F.lit(".gkg.csv.zip \n")))
    early = F.when(F.col("page_id") % 5 == 0, "").otherwise("7 ef http://data.example/0.gkg.csv.zip\r\n")
    listing = F.concat(early, F.lit("10 cd http://data.example/"), n, F.lit(".export.csv.zip\n"), line)
    return v.pages.select("page_id", feeds.window_urls(listing, "data.example").alias("archive"))


@query(
    f"""
with s as (select n, {seed.PUBLISHERS}[1 + (n * 3 + n // {len(seed.TOPICS)}) % {len(seed.PUBLISHERS)}] as publisher from range({seed.ARTICLES}) r(n)),
k as (select 'https://' || publisher || '.example/seed/' || n as url, 'seed-' || (n % {len(seed.TOPICS)}) as slug from s)
select url, null as slug from pages where url is not null union all select url, case when slug <> 'seed-0' then slug end from k
"""
)
def seeded_articles(v: Views) -> DataFrame:
    """The seed corpus beside held articles, loaded twice; seeds that are held stay as they are."""
    spark = v.pages.sparkSession
    seeds = seed.seed_articles(spark).select("url", "slug")
    held = v.pages.where("url is not null").select("url", F.lit(None).cast("string").alias("slug")).unionByName(seeds.where("slug = 'seed-0'").withColumn("slug", F.lit(None).cast("string")))
    return seed.loaded(seed.loaded(held, seeds, "url"), seeds, "url")
