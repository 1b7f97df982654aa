"""Coverage: leanings, spectra, rollups, read models and lists."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import ACCEPTED, CATEGORIES, DEFAULT, LENSES, ROLES
from tidewire.operators.market import TICKER

# Published ratings by domain, and the bands they fall into.
LEANINGS = {
    "theguardian.com": "left", "aljazeera.com": "lean_left", "apnews.com": "lean_left", "cnn.com": "lean_left", "nbcnews.com": "lean_left", "npr.org": "lean_left",
    "politico.com": "lean_left", "washingtonpost.com": "lean_left", "bbc.co.uk": "center", "bbc.com": "center", "thehill.com": "center", "wsj.com": "center",
    "nypost.com": "lean_right", "washingtonexaminer.com": "lean_right", "washingtontimes.com": "lean_right", "dailywire.com": "right", "foxnews.com": "right", "newsmax.com": "right",
}
BANDS = {"left": "left", "lean_left": "left", "center": "centre", "lean_right": "right", "right": "right"}


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def leanings(spark: SparkSession, table: dict[str, str] = LEANINGS) -> DataFrame:
    return spark.createDataFrame(sorted(table.items()), "rated string, leaning string")


def with_leaning(rows: DataFrame, domain: str = "domain", table: dict[str, str] = LEANINGS) -> DataFrame:
    """The rating of the longest rated domain that a host equals or lies under.

    The host's own suffixes, a few each, are looked up in the fixed table: no comparison with every rated domain.
    """
    labels = F.split(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.filter(F.transform(suffixes, lambda s: mapped(table, s)), lambda x: x.isNotNull())
    return rows.withColumn("leaning", F.when(F.col(domain).isNotNull(), F.get(found, F.lit(0))))


def band(leaning: Column) -> Column:
    return mapped(BANDS, leaning)


def public_leaning(leaning: Column, source: Column, known: list[str]) -> Column:
    """A rating shows only with a known source."""
    return F.when(leaning.isNotNull() & source.isin(known), F.struct(leaning.alias("rating"), band(leaning).alias("band"), source.alias("source")))


def spectrum(articles: DataFrame, group: str = "story_id", share: float = DEFAULT.blindspot_share) -> DataFrame:
    """(group, left_n, centre_n, right_n, unrated_n, total, blindspot) of articles with ``leaning``."""
    b = band(F.col("leaning"))
    n = lambda x: F.count_if(b == x).cast("int").alias(f"{x}_n")
    out = articles.groupBy(group).agg(n("left"), n("centre"), n("right"), F.count_if(F.col("leaning").isNull()).cast("int").alias("unrated_n"), F.count("*").cast("int").alias("total"))
    rated, most = F.col("left_n") + F.col("centre_n") + F.col("right_n"), F.greatest("left_n", "centre_n", "right_n")
    dominant = F.when(F.col("left_n") == most, "left").when(F.col("centre_n") == most, "centre").otherwise("right")
    blind = (rated >= 2) & (rated * 2 >= F.col("total")) & (dominant != "centre") & (F.try_divide(most, rated) >= share)
    return out.withColumn("blindspot", F.when(blind, dominant))


def story_list(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories with the count of their accepted articles; stories without any stay."""
    counts = articles.where(F.col("status") == ACCEPTED).groupBy("story_id").agg(F.count("*").cast("int").alias("n"))
    return stories.join(counts, "story_id", "left").withColumn("article_count", F.coalesce("n", F.lit(0))).drop("n")


def story_detail(articles: DataFrame, story: Column) -> DataFrame:
    return articles.where((F.col("story_id") == story) & (F.col("status") == ACCEPTED)).orderBy("published_at", "id")


def sector_rollup(stories: DataFrame, articles: DataFrame, sectors: list[str] = CATEGORIES) -> DataFrame:
    """(category, stories, articles) for every category, empty ones too; accepted articles only."""
    all_of = stories.sparkSession.createDataFrame([(s,) for s in sectors], "category string")
    members = articles.where(F.col("status") == ACCEPTED).groupBy("story_id").agg(F.count("*").alias("n"))
    per_story = stories.select("story_id", "category").join(members, "story_id", "left")
    counts = per_story.groupBy("category").agg(F.countDistinct("story_id").cast("int").alias("s"), F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("a"))
    return all_of.join(counts, "category", "left").select("category", F.coalesce("s", F.lit(0)).alias("stories"), F.coalesce("a", F.lit(0)).alias("articles"))


def dense_counts(rows: DataFrame, column: str, values: list[str] = ROLES) -> DataFrame:
    """(column, n) for every value of a vocabulary."""
    counts = rows.groupBy(column).agg(F.count("*").cast("int").alias("c"))
    return rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").join(counts, column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def comparable_candidates(articles: DataFrame, least: int = DEFAULT.min_publishers) -> DataFrame:
    """(story_id, publishers): stories whose accepted articles come from enough publishers."""
    return articles.where(F.col("status") == ACCEPTED).groupBy("story_id").agg(F.countDistinct("publisher_id").cast("int").alias("publishers")).where(F.col("publishers") >= least)


def comparable_stories(articles: DataFrame, evidence: DataFrame, stories: DataFrame, limit: int = 10) -> DataFrame:
    """Stories that are comparable by their articles and again by the selected evidence, latest first."""
    first = comparable_candidates(articles)
    second = evidence.groupBy("story_id").agg(F.countDistinct("publisher_id").alias("p")).where(F.col("p") >= DEFAULT.min_publishers)
    return stories.join(first, "story_id", "left_semi").join(second, "story_id", "left_semi").orderBy(F.desc("last_seen_at"), "title", "story_id").limit(limit)


def publisher_register(publishers: DataFrame, articles: DataFrame) -> DataFrame:
    counts = articles.groupBy("publisher_id").agg(F.count("*").cast("int").alias("n"))
    return publishers.join(counts, "publisher_id", "left").withColumn("article_count", F.coalesce("n", F.lit(0))).drop("n")


def recent_runs(runs: DataFrame, ledger: str = "ledger", at: str = "started_at", limit: int = 20) -> DataFrame:
    """The latest runs of each ledger."""
    rank = F.row_number().over(Window.partitionBy(ledger).orderBy(F.desc(at), "run_id"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= limit)


# lists


@dataclass
class ListQuery:
    page: int = 1
    size: int = DEFAULT.page_default
    sort: str = ""
    descending: bool = True
    category: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    errors: list[str] = field(default_factory=list)


def parse_list_query(params: dict[str, str], sortable: list[str], most: int = DEFAULT.page_max) -> ListQuery:
    """A list query from request parameters; all errors are collected and raised as one message."""
    out = ListQuery(sort=sortable[0])

    def number(name: str, default: int, top: int | None) -> int:
        raw = params.get(name, str(default))
        if not raw.isdigit() or int(raw) < 1 or (top and int(raw) > top):
            out.errors.append(f"{name} must be a whole number from 1" + (f" to {top}" if top else ""))
            return default
        return int(raw)

    out.page, out.size = number("page", 1, None), number("pageSize", DEFAULT.page_default, most)
    if "sort" in params:
        name, _, way = params["sort"].partition(":")
        if name not in sortable or way not in ("", "asc", "desc"):
            out.errors.append("sort must be one of " + ", ".join(sortable) + " with :asc or :desc")
        else:
            out.sort, out.descending = name, way != "asc"
    if params.get("category"):
        if params["category"] not in CATEGORIES:
            out.errors.append("category is unknown")
        out.category = params["category"]
    for name, attribute in (("dateFrom", "start"), ("dateTo", "end")):
        if params.get(name):
            try:
                at = datetime.fromisoformat(params[name].replace("Z", "+00:00"))
                at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
                if name == "dateTo" and len(params[name]) == 10:
                    at += timedelta(days=1) - timedelta(milliseconds=1)
                setattr(out, attribute, at)
            except ValueError:
                out.errors.append(f"{name} is no date")
    if out.start and out.end and out.start > out.end:
        out.errors.append("dateFrom is after dateTo")
    if out.errors:
        raise ValueError("; ".join(out.errors))
    return out


def paged(rows: DataFrame, query: ListQuery, key: str = "id") -> DataFrame:
    """A page by the sort field, ties by the key."""
    order = F.desc(query.sort) if query.descending else F.asc(query.sort)
    return rows.orderBy(order, key).offset((query.page - 1) * query.size).limit(query.size)


def envelope(total: int, query: ListQuery) -> dict[str, int]:
    return {"page": query.page, "pageSize": query.size, "total": total, "totalPages": max(1, math.ceil(total / query.size))}


# owned artifacts


def current_analysis(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, lens, run_id): the latest completed run of each story and lens, of stories that have an accepted member."""
    alive = articles.where(F.col("status") == ACCEPTED).select("story_id")
    return runs.where("status = 'completed'").groupBy("story_id", "lens").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id")).join(alive, "story_id", "left_semi")


def reader_gate(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, role, refusal) of wanted runs: the first reason that holds."""
    lens = mapped(LENSES, F.col("role"))
    met = wanted.join(runs.select("run_id", "status", "lens", F.lit(True).alias("there")), "run_id", "left")
    refusal = F.when(F.col("there").isNull(), "not_found").when(F.col("status") != "completed", "not_completed").when(~F.coalesce(F.col("lens") == lens, F.lit(False)), "wrong_lens")
    return met.select("run_id", "role", refusal.alias("refusal"))


def brief_list(briefs: DataFrame, brief_articles: DataFrame) -> DataFrame:
    counts = brief_articles.groupBy("brief_id").agg(F.count("*").cast("int").alias("n"))
    return briefs.join(counts, "brief_id", "left").withColumn("article_count", F.coalesce("n", F.lit(0))).drop("n")


def attach_analysis(briefs: DataFrame, attached: DataFrame, evidence: DataFrame) -> DataFrame:
    """(brief_id, missing, verdict) when an analysis's evidence (brief_id, article_id, has_provenance) is saved to briefs.

    Articles that are attached already cost nothing; the rest must fit the capacity, and every snapshot needs its provenance.
    """
    missing = evidence.join(attached, ["brief_id", "article_id"], "left_anti").groupBy("brief_id").agg(F.countDistinct("article_id").cast("int").alias("missing"))
    bare = evidence.groupBy("brief_id").agg(F.every("has_provenance").alias("sound"))
    held = attached.groupBy("brief_id").agg(F.count("*").alias("held"))
    met = briefs.join(bare, "brief_id").join(missing, "brief_id", "left").join(held, "brief_id", "left")
    over = F.coalesce("held", F.lit(0)) + F.coalesce("missing", F.lit(0)) > F.col("capacity")
    return met.select("brief_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(~F.col("sound"), "no_provenance").when(over, "over_capacity").otherwise("attached").alias("verdict"))


def attach_article(briefs: DataFrame, attached: DataFrame, wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """(brief_id, article_id, verdict) of single articles: accepted members only, not twice, not beyond the capacity."""
    member = articles.where(F.col("status") == ACCEPTED).select(F.col("id").alias("article_id"), F.lit(True).alias("member"))
    twice = attached.select("brief_id", "article_id", F.lit(True).alias("twice"))
    held = attached.groupBy("brief_id").agg(F.count("*").alias("held"))
    met = wanted.join(briefs, "brief_id").join(member, "article_id", "left").join(twice, ["brief_id", "article_id"], "left").join(held, "brief_id", "left")
    verdict = F.when(F.col("member").isNull(), "not_a_member").when(F.col("twice"), "already_attached").when(F.coalesce("held", F.lit(0)) >= F.col("capacity"), "full").otherwise("attached")
    return met.select("brief_id", "article_id", verdict.alias("verdict"))


def merge_history(records: DataFrame, limit: int = 10) -> DataFrame:
    """The latest merges of each survivor, with their total."""
    w = Window.partitionBy("survivor")
    rows = records.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("merged_at"), "merged")), "total": F.count("*").over(w).cast("int")})
    return rows.where(F.col("rank") <= limit)


def watchlist(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Watched tickers and sectors, each once an owner, with quotes joined to tickers and a status."""
    ticker = F.upper(F.trim("value"))
    value = F.when(F.col("kind") == "ticker", F.when(ticker.rlike(TICKER), ticker)).otherwise(F.when(F.col("value").isin(CATEGORIES), F.col("value")))
    kept = items.withColumn("value", value).where("value is not null").dropDuplicates(["owner", "kind", "value"])
    met = kept.join(quotes.withColumn("kind", F.lit("ticker")).withColumnRenamed("ticker", "value"), ["kind", "value"], "left")
    return met.withColumn("status", F.when(F.col("kind") == "sector", "none").when(F.col("price").isNotNull(), "ready").otherwise("unavailable"))


def user_search(users: DataFrame, role: str | None = None, active: bool | None = None, email: str | None = None) -> DataFrame:
    out = users
    if role is not None:
        out = out.where(F.col("role") == role)
    if active is not None:
        out = out.where(F.col("active") == active)
    if email is not None:
        out = out.where(F.col("email").ilike(f"%{email}%"))
    return out.orderBy(F.desc("created_at"), "id")
