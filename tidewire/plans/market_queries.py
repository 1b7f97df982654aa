"""Queries: indicators, quotes, panels, study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import market, resolve, study
from tidewire.plans.registry import query
from tidewire.plans.views import Views, with_views


@query(with_views("with r as (select *, row_number() over (partition by ticker order by date desc) as k, count(*) over (partition by ticker) as n from closes) select ticker, case when max(n) >= 20 then round(avg(adj_close) filter (where k <= 20), 2) end as sma from r group by ticker", "closes"))
def moving_average(v: Views) -> DataFrame:
    """H1: mean of the last 20 closes."""
    return market.sma(v.closes, 20).withColumn("sma", F.round("sma", 2))


@query(
    with_views(
        """
with recursive d as (select ticker, row_number() over (partition by ticker order by date) as k, adj_close - lag(adj_close) over (partition by ticker order by date) as x from closes),
seed as (select ticker, avg(greatest(x, 0)) as g, avg(greatest(-x, 0)) as l from d where k between 2 and 15 group by ticker having count(*) = 14),
w as (select ticker, cast(15 as bigint) as k, g, l from seed union all select w.ticker, w.k + 1, (w.g * 13 + greatest(d.x, 0)) / 14, (w.l * 13 + greatest(-d.x, 0)) / 14 from w join d on d.ticker = w.ticker and d.k = w.k + 1)
select ticker, round(case when arg_max(g, k) = 0 and arg_max(l, k) = 0 then 50 when arg_max(l, k) = 0 then 100 else 100 - 100 / (1 + arg_max(g, k) / arg_max(l, k)) end, 4) as rsi from w group by ticker
""",
        "closes",
    ).replace("with closes", "with recursive closes", 1).replace(", recursive d", ", d")
)
def relative_strength(v: Views) -> DataFrame:
    """H2: Wilder's index over 14 days."""
    return market.rsi(v.closes).withColumn("rsi", F.round("rsi", 4))


@query(with_views("with r as (select ticker, ln(adj_close / lag(adj_close) over (partition by ticker order by date)) as r from closes) select ticker, round(stddev_samp(r) * sqrt(252) * 100, 4) as volatility from r group by ticker", "closes"))
def annual_volatility(v: Views) -> DataFrame:
    """H3: annualised volatility."""
    return market.volatility(v.closes).withColumn("volatility", F.round("volatility", 4))


@query(with_views("with r as (select *, lag(adj_close) over (partition by ticker order by date) as p, row_number() over (partition by ticker order by date desc) as k from closes) select ticker, round(adj_close, 4) as price, round(adj_close - p, 4) as change, round((adj_close - p) / p * 100, 4) as change_percent from r where k = 1", "closes"))
def latest_quotes(v: Views) -> DataFrame:
    """Quotes from the last two closes."""
    return market.quotes(v.closes).select("ticker", *[F.round(c, 4).alias(c) for c in ("price", "change", "change_percent")])


@query("select p_partkey, case when p_partkey % 3 = 0 then 'BRK.B' when p_partkey % 3 = 1 then null else upper(replace(p_brand, '#', '')) end as ticker from part")
def normal_tickers(v: Views) -> DataFrame:
    """H4: tickers normalised."""
    raw = F.when(F.col("p_partkey") % 3 == 0, " brk.b ").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.regexp_replace("p_brand", "#", ""))
    return v.part.select("p_partkey", market.normal_ticker(raw).alias("ticker"))


@query(
    with_views(
        """
with o as (select distinct r.story_id, trim(regexp_replace(lower(a.surface_name), '[^a-z0-9]+', ' ', 'g')) as name from annotations a join reports r on r.id = a.article_id where a.kind = 'organization' and r.status = 'auto_accepted'), n as (select *, row_number() over (partition by story_id order by name) as k, count(*) over (partition by story_id) as total from o)
select story_id, name as canonical_name, total::int as total from n where k <= 8
""",
        "annotations",
        "reports",
    )
)
def story_companies(v: Views) -> DataFrame:
    """Listed organisations of each story."""
    found = resolve.candidates(v.annotations).where("kind = 'organization'")
    entities = found.select(F.sha2("name", 256).alias("id"), *resolve.IDENTITY, F.col("name").alias("canonical_name"), F.lit("X").alias("ticker"))
    return market.story_entities(v.reports, v.annotations, entities).select("story_id", "canonical_name", "total")


@query("select user_id as story_id, case when bool_or(event_type = 'click') then 'ready' when bool_or(event_type = 'view') then 'unavailable' else 'empty' end as status from events group by user_id")
def panel_states(v: Views) -> DataFrame:
    """H6: the state of each story's panels."""
    state = F.when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "view", "unavailable").otherwise("none")
    return market.panel_status(v.events.select(F.col("user_id").alias("story_id"), state.alias("state")))


@query(with_views("with r as (select *, row_number() over (partition by story_id order by at_s, id) as k from articles where status = 'auto_accepted') select story_id, list(substr(body, 1, 900) order by k) as blocks, 'x' as note from r where k <= 8 group by story_id", "articles"))
def market_read_inputs(v: Views) -> DataFrame:
    """K6: excerpts for a market read."""
    return market.market_read_input(v.articles, v.stories.select("story_id", F.lit("x").alias("note")))


@query(
    """
with recursive l as (select user_id as card_id, cast(event_id % 6 as int) as grade, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events),
s as (select card_id, 0::bigint as k, 0 as repetitions, 2.5::double as ease, 0 as days from (select distinct card_id from l)
union all select l.card_id, l.k, case when grade < 3 then 0 else repetitions + 1 end, greatest(1.3, ease + (0.1 - (5 - grade) * (0.08 + (5 - grade) * 0.02))), case when grade < 3 or repetitions = 0 then 1 when repetitions = 1 then 6 else greatest(days + 1, floor(days * ease + 0.5)::int) end from s join l on l.card_id = s.card_id and l.k = s.k + 1)
select s.card_id, repetitions, round(ease, 5) as ease, days, n::int as reviews from s join l on l.card_id = s.card_id and l.k = s.k where s.k = n
"""
)
def card_states(v: Views) -> DataFrame:
    """The state of every card after its reviews."""
    return study.card_states(v.reviews).select("card_id", "repetitions", F.round("ease", 5).alias("ease"), "days", "reviews")


@query("select user_id as card_id, floor(epoch(max(ts)))::bigint + 6 * 86400 as due from events group by user_id")
def due_dates(v: Views) -> DataFrame:
    """Due dates six days on."""
    last = v.reviews.groupBy("card_id").agg(F.max(F.col("reviewed_at").cast("timestamp")).alias("at"))
    return last.select("card_id", F.unix_timestamp(study.due_at(F.col("at"), F.lit(6))).alias("due"))


def _cards(v: Views) -> DataFrame:
    return v.orders.select(F.col("o_orderkey").alias("card_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("owner"), F.col("o_custkey").alias("claim_id"), F.col("o_orderdate").cast("timestamp").alias("due_at"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"))


NOW = "timestamp '1998-01-01'"


@query(f"select o_custkey % 50 as owner, count(*)::int as total, count(*) filter (where o_orderdate <= {NOW})::int as due, epoch(min(o_orderdate) filter (where o_orderdate > {NOW}))::bigint as next_due from orders group by 1")
def study_summary(v: Views) -> DataFrame:
    """I4, G-b, K9: totals, due cards and the next date."""
    return study.summary(_cards(v), F.expr(NOW)).withColumn("next_due", F.unix_timestamp("next_due"))


@query("select o_orderkey as card_id from orders where o_custkey % 3 = 0 or o_orderkey % 7 = 0")
def valid_cards(v: Views) -> DataFrame:
    """Cards with a citation in a frozen set."""
    cards = _cards(v)
    return study.citation_valid(cards, cards.where("card_id % 7 = 0"), cards.where("claim_id % 3 = 0")).select("card_id")


@query(f"select o_orderkey as card_id from orders where o_custkey % 50 = 7 and o_orderdate <= {NOW} order by o_orderdate, o_orderkey limit 20")
def study_session(v: Views) -> DataFrame:
    """The deck of one session."""
    return study.session(_cards(v).where("owner = 7"), F.expr(NOW)).select("card_id")


@query(f"select o_orderkey as card_id from orders where (o_orderpriority ilike '%urg%' or o_orderstatus ilike '%urg%') and o_orderdate > {NOW}")
def card_search(v: Views) -> DataFrame:
    """Cards that hold a text and are not due."""
    return study.card_list(_cards(v), "urg", "later", F.expr(NOW)).select("card_id")


@query("with a as (select o_orderkey as card, o_orderkey as art from orders union all select x.o_orderkey, y.o_orderkey from orders x join orders y on x.o_custkey = y.o_custkey) select card as card_id, count(*)::int as citations, min(o.o_orderpriority) as first_title from a join orders o on o.o_orderkey = a.art group by card")
def card_citations(v: Views) -> DataFrame:
    """Citations by claim and by card."""
    cards = _cards(v)
    of_claim = v.orders.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("article_id"))
    own = cards.select("card_id", F.col("card_id").alias("article_id"))
    return study.card_citations(cards, of_claim, own, v.reports).select("card_id", F.size("citations").alias("citations"), F.get("citations", F.lit(0))["title"].alias("first_title"))


@query("with c as (select o_custkey % 50 as owner, o_orderkey as claim_id, o_orderstatus as t, o_orderpriority as x from orders where o_orderkey % 2 = 0 and not (o_orderkey % 5 = 0)) select owner, claim_id, sha256(t || chr(0) || x) as key, case when t = 'F' then 'cached' end as question from c".replace("chr(0)", "chr(1)"))
def deck_generation(v: Views) -> DataFrame:
    """Cited claims without a card, with cached questions (the key's separator is a printable-safe one here)."""
    claims = v.orders.select((F.col("o_custkey") % 50).alias("owner"), F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("claim_type"), F.col("o_orderpriority").alias("text"))
    held = claims.where("claim_id % 5 = 0").select("owner", "claim_id")
    keys = claims.where("claim_type = 'F'").select(study.question_key(F.col("claim_type"), F.col("text")).alias("key")).distinct().withColumn("question", F.lit("cached"))
    new = study.new_cards(claims, held, claims.where("claim_id % 2 = 0").select("claim_id"), keys)
    return new.select("owner", "claim_id", F.sha2(F.concat("claim_type", F.lit("\1"), "text"), 256).alias("key"), "question")


@query("select event_id as review_id from events where user_id = 5")
def review_history(v: Views) -> DataFrame:
    """The log of one card."""
    return study.history(v.reviews, F.lit(5)).select("review_id")


@query(
    """
with h as (select p_partkey as key, case when p_partkey % 5 <> 0 then p_name end as old, 1704067200 + p_partkey % 90 as stored from part where p_partkey % 3 <> 0),
a as (select p_partkey as key, 1704067200 + 100 as asked, p_partkey % 7 <> 0 as ok, p_type as fresh from part),
j as (select a.*, old, stored, coalesce(asked - stored < 60, false) as live from a left join h using (key)),
s as (select *, case when live then 'hit' when not ok then 'outage' when stored is not null then 'expired' else 'miss' end as state from j)
select key, state, case when live then old when ok then fresh end as value, case state when 'hit' then stored when 'outage' then stored else asked end as stored from s
"""
)
def cached_quotes(v: Views) -> DataFrame:
    """H8: answers through a cache of 60 seconds, and when each key is stored after them."""
    key = F.col("p_partkey")
    at = lambda seconds: F.timestamp_seconds(seconds + 1704067200)
    held = v.part.where(key % 3 != 0).select(key.alias("key"), F.when(key % 5 != 0, F.col("p_name")).alias("value"), at(key % 90).alias("stored_at"))
    fetched = v.part.select(key.alias("key"), F.col("p_type").alias("value"), (key % 7 != 0).alias("ok"))
    answers, after = market.read_through(v.part.select(key.alias("key"), at(F.lit(100)).alias("asked_at")), held, fetched, 60)
    stored = after.select("key", F.unix_timestamp("stored_at").alias("stored"))
    return answers.join(stored, "key", "left").select("key", "state", "value", "stored")
