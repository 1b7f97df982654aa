"""The news frames over the driver's tables, once for Spark and once as SQL for DuckDB.

Both texts are built from one dialect-neutral body; only what the two engines spell differently is filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200

ARTICLES = f"""
select d.doc_id as id, d.source as publisher_id, trim(split_part(d.text, '.', 1)) as title, d.text as body, {EPOCH} + d.doc_id * 1020 as at_s,
  e.embedding as embedding, cast(e.label as bigint) as story_id,
  case when e.label is null then null when d.doc_id % 7 = 0 then 'pending_review' else 'auto_accepted' end as status,
  case d.doc_id % 5 when 0 then 'metadata_only' when 1 then 'feed_excerpt' when 2 then 'api_content' when 3 then 'licensed_full_text' else 'feed_excerpt' end as mode,
  case when d.doc_id % 4 = 0 then null else cast(d.doc_id % 11 as double) - 5 end as tone, d.lang as lang
from documents d left join embeddings e on d.doc_id = e.vec_id
"""

STORIES = """
select story_id, 'Story ' || cast(story_id as varchar(20)) as title,
  case story_id % 8 when 0 then 'politics' when 1 then 'business' when 2 then 'technology' when 3 then 'science' when 4 then 'health' when 5 then 'world' when 6 then 'sports' else 'entertainment' end as category,
  min(at_s) as first_at, max(at_s) as last_at
from articles where status = 'auto_accepted' group by story_id
"""

PUBLISHERS = """
select distinct source as publisher_id, lower(source) || '.example' as domain,
  case length(source) % 2 when 0 then 'licensed' else 'syndicated_excerpt' end as terms_class,
  case cast(substr(source, 4) as int) % 6 when 0 then 'left' when 1 then 'lean_left' when 2 then 'center' when 3 then 'lean_right' when 4 then 'right' else null end as leaning
from documents
"""

# an order is an article, parts and suppliers are what it names
ANNOTATIONS = """
select l.l_orderkey as article_id, case when l.l_linenumber % 3 = 0 then 'person' else 'organization' end as kind, p.p_name as surface_name,
  l.l_linenumber * 7 as char_offset, cast(null as varchar(20)) as feature_id
from lineitem l join part p on l.l_partkey = p.p_partkey
union all
select l.l_orderkey, 'theme', p.p_type, l.l_linenumber * 11, cast(null as varchar(20)) from lineitem l join part p on l.l_partkey = p.p_partkey
union all
select l.l_orderkey, 'location', n.n_name, l.l_linenumber * 13, cast(s.s_nationkey as varchar(20)) from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey
"""

REPORTS = "select o_orderkey as id, o_orderpriority as title, o_orderdate as published_at, o_custkey % 10 as story_id, case when o_custkey % 3 = 0 then 'pending_review' else 'auto_accepted' end as status from orders"

REVIEWS = "select user_id as card_id, event_id as review_id, ts as reviewed_at, cast(event_id % 6 as int) as grade from events"

CLOSES = """
select n.n_name as ticker, cast(o.o_orderdate as date) as date, avg(o.o_totalprice) as adj_close
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by n.n_name, cast(o.o_orderdate as date)
"""

SIGHTINGS = """
select user_id as url_key, event_id as seq, case event_type when 'click' then 'metadata_only' when 'view' then 'feed_excerpt' when 'purchase' then 'licensed_full_text' else 'api_content' end as mode,
  case when event_id % 3 = 0 then null else value end as tone, case when event_id % 2 = 0 then 'site' || cast(user_id as varchar(20)) || '.example' else event_type end as title,
  'site' || cast(user_id as varchar(20)) || '.example' as domain, event_type || cast(event_id as varchar(20)) as body
from events
"""

BODIES = {
    "articles": ARTICLES, "stories": STORIES, "publishers": PUBLISHERS, "annotations": ANNOTATIONS, "reports": REPORTS, "reviews": REVIEWS, "closes": CLOSES, "sightings": SIGHTINGS,
}
NEEDS = {"stories": ["articles"]}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"]
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


class Views:
    """Frames by name, built when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = self._view(name) if name in BODIES else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def _view(self, name: str) -> DataFrame:
        import re

        body = BODIES[name]
        used = {t: getattr(self, t) for t in {*re.findall(r"(?:from|join)\s+([a-z]+)", body)}}
        df = self.spark.sql(re.sub(r"\b(from|join)\s+([a-z]+)", lambda m: f"{m[1]} {{{m[2]}}}", body), **used)
        if name == "articles":
            df = df.withColumn("published_at", F.timestamp_seconds("at_s"))
        if name == "stories":
            df = df.withColumns({"first_seen_at": F.timestamp_seconds("first_at"), "last_seen_at": F.timestamp_seconds("last_at")})
        return df


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named frames in front."""
    if not names:
        return sql
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    named, body = ", ".join(f"{n} as ({BODIES[n]})" for n in wanted), sql.lstrip()
    start = next((w for w in ("with recursive ", "with ") if body.lower().startswith(w)), None)
    return f"{start or 'with '}{named}{', ' if start else ' '}{body[len(start or '') :]}"
