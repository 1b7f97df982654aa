"""Reading the entity graph.  Edges are (a, b, article_id), one row for each pair and citing article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import DEFAULT
from tidewire.operators.resolve import bounded_pairs, weighted_pairs

# Names that the views leave out, as folded names.
EXCLUDED = ["american", "americans", "australian", "british", "canadian", "canadians", "chinese", "french", "iranian", "russian", "spanish"]


def citation_base(edges: DataFrame, entities: DataFrame, annotations: DataFrame | None = None, theme: str | None = None) -> DataFrame:
    """Edges between entities that are not excluded, of articles with the theme where one is given."""
    shown = entities.where(~F.col("name").isin(EXCLUDED)).select("id")
    out = edges.join(shown.withColumnRenamed("id", "a"), "a", "left_semi").join(shown.withColumnRenamed("id", "b"), "b", "left_semi")
    if theme is not None:
        themed = annotations.where((F.col("kind") == "theme") & (F.col("surface_name") == theme)).select("article_id")
        out = out.join(themed, "article_id", "left_semi")
    return out.select("a", "b", "article_id")


def ends(edges: DataFrame) -> DataFrame:
    """(id, article_id) of both ends, each once; dealt by article, so one shuffle serves this and joins with articles."""
    return edges.repartition("article_id").select(F.explode(F.array("a", "b")).alias("id"), "article_id").distinct()


def presence(edges: DataFrame) -> DataFrame:
    """(id, presence): distinct articles of each entity over both ends."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("presence"))


def view_nodes(edges: DataFrame, entities: DataFrame, limit: int = DEFAULT.view_nodes) -> DataFrame:
    return presence(edges).join(entities, "id").orderBy(F.desc("presence"), "name", "id").limit(limit)


def view_edges(edges: DataFrame, nodes: DataFrame, k: int = DEFAULT.view_edges) -> DataFrame:
    """(a, b, weight) among the nodes, bounded at both ends."""
    inside = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return bounded_pairs(weighted_pairs(inside), k).orderBy(F.desc("weight"), "a", "b")


def substrate(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: entities, distinct articles and the span of their dates."""
    rows = ends(edges).join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return rows.agg(F.countDistinct("id").cast("int").alias("entities"), F.countDistinct("article_id").cast("int").alias("articles"), F.min("published_at").alias("from_at"), F.max("published_at").alias("to_at"))


def focus_profile(edges: DataFrame, articles: DataFrame, aliases: DataFrame, focus: Column, entities: DataFrame) -> DataFrame:
    """One row: own articles, span, and the aliases of the focus in order, an empty array where it has none."""
    own = ends(edges).where(F.col("id") == focus).join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id").groupBy("id").agg(F.count("*").cast("int").alias("articles"), F.min("published_at").alias("from_at"), F.max("published_at").alias("to_at"))
    named = entities.where(F.col("id") == focus).join(aliases.select("kind", "feature_key", F.col("target").alias("name"), F.col("name").alias("alias")), ["kind", "feature_key", "name"])
    also = named.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return own.join(also, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def neighbours(edges: DataFrame, entities: DataFrame, focus: Column, limit: int = DEFAULT.view_nodes - 1) -> DataFrame:
    """Entities tied to the focus by weight, presence, name and id, with the total before the limit."""
    near = edges.where((F.col("a") == focus) | (F.col("b") == focus)).select(F.when(F.col("a") == focus, F.col("b")).otherwise(F.col("a")).alias("id"))
    tied = near.groupBy("id").agg(F.count("*").alias("weight"))
    total = tied.agg(F.count("*").cast("int").alias("total"))
    return tied.join(presence(edges), "id").join(entities.select("id", "name"), "id").orderBy(F.desc("weight"), F.desc("presence"), "name", "id").limit(limit).join(F.broadcast(total))


def theme_facets(edges: DataFrame, annotations: DataFrame, focus: Column, limit: int = DEFAULT.theme_facets) -> DataFrame:
    """The themes of the focus's articles, by articles; never narrowed by an active theme."""
    own = ends(edges).where(F.col("id") == focus).select("article_id")
    themes = annotations.where(F.col("kind") == "theme").join(own, "article_id", "left_semi")
    return themes.groupBy(F.col("surface_name").alias("theme")).agg(F.countDistinct("article_id").cast("int").alias("articles")).orderBy(F.desc("articles"), "theme").limit(limit)


def edge_evidence(edges: DataFrame, articles: DataFrame, stories: DataFrame, x: Column, y: Column, limit: int = DEFAULT.edge_citations) -> DataFrame:
    """Citations of a pair, in either order, newest first, with the full weight; a story shows only for accepted members."""
    cited = edges.where((F.col("a") == F.least(x, y)) & (F.col("b") == F.greatest(x, y))).select("article_id")
    total = cited.agg(F.count("*").cast("int").alias("weight"))
    story = stories.select("story_id", F.col("title").alias("story_title"))
    met = cited.join(articles, cited.article_id == articles.id).drop("article_id")
    shown = met.withColumn("story_id", F.when(F.col("status") == "auto_accepted", F.col("story_id"))).join(story, "story_id", "left")
    return shown.select("id", "title", "published_at", "story_id", "story_title").orderBy(F.desc("published_at"), "id").limit(limit).join(F.broadcast(total))


def samples(edges: DataFrame, articles: DataFrame, per_entity: int = DEFAULT.proposal_sample) -> DataFrame:
    """(id, article_id, rank): the latest articles of each entity."""
    rows = ends(edges).join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("published_at"), "article_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_entity).select("id", "article_id", "rank")


def drawing(view: DataFrame) -> DataFrame:
    """(id, peak, strongest, neighbours): scale helpers for a drawn view of (a, b, weight)."""
    both = view.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").union(view.select("b", "a", "weight"))
    own = both.groupBy("id").agg(F.max_by("other", F.struct("weight", "other")).alias("strongest"), F.array_sort(F.collect_list("other")).alias("neighbours"))
    return own.join(F.broadcast(view.agg(F.greatest(F.coalesce(F.max("weight"), F.lit(1)), F.lit(1)).alias("peak"))))


def proposal_queue(proposals: DataFrame, entities: DataFrame, edges: DataFrame, articles: DataFrame, limit: int = DEFAULT.page_default) -> DataFrame:
    """Open merge proposals, most similar first, with both entities and their latest articles."""
    latest = samples(edges, articles).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"]).alias("sample"))
    named = entities.join(latest, "id", "left").select("kind", "feature_key", "name", "canonical_name", "articles", F.coalesce("sample", F.array().cast("array<long>")).alias("sample"))
    side = lambda p: named.select("kind", "feature_key", F.col("name").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("canonical_name", "articles", "sample")])
    met = proposals.join(side("survivor"), ["kind", "feature_key", "survivor"]).join(side("merged"), ["kind", "feature_key", "merged"])
    return met.orderBy(F.desc("similarity"), "survivor", "merged", "kind", "feature_key").limit(limit)
