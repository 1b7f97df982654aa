"""Queries: hybrid search."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.functions.stem import stems_sql
from tidewire.operators import search, timeline
from tidewire.operators.textindex import TextIndex
from tidewire.plans.registry import query
from tidewire.plans.views import Views, with_views
from tidewire.staging import shared_dir, staged

QUERY = "haha eder"
CFG = Config(max_distance=0.95, pool=50)
STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


def _words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' and t not in ({STOP}))"


INDEX = f"""tok as (select id, unnest({_words('title')}) as word, 1.0::double as w from articles union all select id, unnest({_words('body')}), 0.4::double from articles),
stok as (select story_id, unnest({_words('title')}) as word, 1.0::double as w from stories), vocabulary as (select word from tok union select word from stok union select unnest(['haha', 'eder'])),
{stems_sql('vocabulary', 'word', 'stems')},
postings as (select stem as term, id, sum(w) as weight from tok join stems using (word) group by term, id), spost as (select stem as term, story_id, sum(w) as weight from stok join stems using (word) group by all),
asked as (select distinct stem as term from stems where word in ('haha', 'eder'))"""
LEXICAL = f"""{INDEX}, own as (select id, sum(weight) as r from postings where term in (select term from asked) group by id having count(distinct term) = 2),
lex as (select a.id, coalesce(own.r, 0) as score from articles a join own using (id) where a.status = 'auto_accepted'), lexr as (select id, row_number() over (order by round(score, 6) desc, id) as lexical_rank from lex)"""
SEMANTIC = """q as (select cast(embedding as double[]) as qv from embeddings where vec_id = 0), d as (select a.id, 1 - list_cosine_similarity(cast(a.embedding as double[]), q.qv) as distance from articles a, q where a.status = 'auto_accepted' and a.embedding is not null),
pool as (select * from d order by distance, id limit 50), sem as (select id, row_number() over (order by distance, id) as semantic_rank from pool where distance <= 0.95)"""
FUSED = f"{LEXICAL}, {SEMANTIC}, fused as (select coalesce(lexr.id, sem.id) as id, coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0) as score from lexr full outer join sem on lexr.id = sem.id)"


def _at_rest(v: Views, name: str, rows: DataFrame, key: str) -> TextIndex:
    """The index of a frame of these tables, built where there is none yet; the path tells the tables' files, so other files have another index."""
    hadoop = v.spark._jvm.org.apache.hadoop.fs
    files = []
    for table in ("documents", "embeddings"):
        path = hadoop.Path(f"{v.sf_dir}/{table}.parquet")
        for s in path.getFileSystem(v.spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{v.sf_dir}/{table}.parquet{{,/*}}")):
            files.append((str(s.getPath()), s.getLen(), s.getModificationTime()))
    digest = hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:32]
    index = TextIndex(v.spark, f"{shared_dir(v.spark)}/tidewire/index/{digest}/{name}", key, "bigint")
    index.add(rows, 0, "title", "body")
    return index


def _indexes(v: Views) -> tuple[TextIndex, TextIndex]:
    return _at_rest(v, "articles", v.articles, "id"), _at_rest(v, "stories", v.stories.withColumn("body", F.lit(None).cast("string")), "story_id")


def _found(v: Views) -> tuple[DataFrame, DataFrame, list[str]]:
    """The postings of the query's terms, of articles and of stories, and the terms."""
    terms = search.analyzed(v.spark, QUERY)
    articles, stories = _indexes(v)
    return articles.of(terms), stories.of(terms), terms


def _vector(v: Views) -> list[float]:
    return list(v.embeddings.where("vec_id = 0").first()["embedding"])


def _lexical(v: Views) -> DataFrame:
    return search.lexical(v.articles, *_found(v))


@query(with_views(f"with {INDEX} select term, count(*) as articles, round(sum(weight), 3) as weight from postings group by term", "articles", "stories"))
def text_index(v: Views) -> DataFrame:
    """The weighted index of stems at rest, by term."""
    return _indexes(v)[0].all().groupBy("term").agg(F.count("*").alias("articles"), F.round(F.sum("weight"), 3).alias("weight"))


@query(with_views(f"with {LEXICAL} select id, lexical_rank from lexr", "articles", "stories"))
def lexical_search(v: Views) -> DataFrame:
    """Articles that hold all words, ranked."""
    return _lexical(v)


@query(with_views(f"with {INDEX} select id, round(sum(weight), 4) as rank from postings where term in (select term from asked) group by id having count(distinct term) = 2 order by sum(weight) desc, id limit 3", "articles", "stories"))
def top_matches(v: Views) -> DataFrame:
    """The heaviest articles that hold all words, read tier by tier."""
    return _indexes(v)[0].search(QUERY, 3).withColumn("rank", F.round("rank", 4))


@query(with_views(f"with {SEMANTIC} select id, semantic_rank from sem", "articles"))
def semantic_search(v: Views) -> DataFrame:
    """The nearest articles, then those near enough."""
    return search.semantic(v.articles, _vector(v), CFG)


@query(with_views(f"with {FUSED} select id, round(score, 7) as score from fused", "articles", "stories"))
def fused_search(v: Views) -> DataFrame:
    """Reciprocal rank fusion."""
    return search.fused(_lexical(v), search.semantic(v.articles, _vector(v), CFG)).withColumn("score", F.round("score", 7))


@query(with_views(f"with {FUSED} select f.id, s.category from fused f join articles a using (id) join stories s using (story_id) where s.category = 'world' and a.at_s >= 1704067200 + 20000", "articles", "stories"))
def filtered_search(v: Views) -> DataFrame:
    """Filters after fusion."""
    hits = search.fused(_lexical(v), search.semantic(v.articles, _vector(v), CFG))
    return search.filtered(hits, v.articles, v.stories, "world", F.timestamp_seconds(F.lit(1704067200 + 20000))).select("id", "category")


@query(
    with_views(
        f"""
with {FUSED}, h as (select f.id, f.score, s.title as story_title from fused f join articles a using (id) join stories s using (story_id)), n as (select *, row_number() over (order by score desc, id) as pos from h)
select pos, id, story_title, (select count(*) from h) as total from n where pos > 5 and pos <= 15
""",
        "articles",
        "stories",
    )
)
def search_page(v: Views) -> DataFrame:
    """A page of hydrated hits, with the total of all pages."""
    hits = staged(search.hybrid(v.articles, v.stories, *_found(v), _vector(v), CFG), "hits")
    rows, total = search.page(hits, 2, 5)
    more, _ = search.page(hits, 3, 5)
    return search.hydrated(rows.union(more), v.articles, v.stories).select("pos", "id", "story_title").join(total)


@query(with_views(f"with {LEXICAL} select id, 1.0 / (60 + lexical_rank) as score from lexr", "articles", "stories"))
def degraded_search(v: Views) -> DataFrame:
    """Without a vector the words decide alone."""

    def broken(texts: list[str]) -> list[list[float]]:
        raise RuntimeError("no provider")

    return search.fused(_lexical(v), search.semantic(v.articles, search.query_vector("x", broken), CFG))


@query(
    with_views(
        f"""
with {FUSED}, h as (select a.id, a.at_s, a.story_id from fused f join articles a using (id) join stories s using (story_id) order by f.score desc, a.id limit 200), x as (select min(at_s) as f, max(at_s) as t from h)
select (select count(*) from h)::int as points, case when t // 3600 - f // 3600 + 1 <= 60 then 'hour' when t // 86400 - f // 86400 + 1 <= 60 then 'day' else 'week' end as granularity from x
""",
        "articles",
        "stories",
    )
)
def search_timeline(v: Views) -> DataFrame:
    """The axis of the most relevant hits."""
    hits = search.hybrid(v.articles, v.stories, *_found(v), _vector(v), CFG).orderBy(F.desc("score"), "id").limit(200)
    points = hits.select(F.lit(0).alias("g"), "id", F.unix_timestamp("published_at").alias("at"))
    return timeline.axis(points, points.where("false").select("g", "at"), ["g"]).select("points", "granularity")
