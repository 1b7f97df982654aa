"""Evidence sets: ranked candidates, bounded selection, freezing."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import DEFAULT, Config
from tidewire.functions.text import content_hash, excerpt
from tidewire.functions.vectors import cosine, cosine_distance
from tidewire.operators.cluster import accepted, centroids, similar_pairs
from tidewire.operators.ingest import weakest_mode
from tidewire.staging import joined_by_count, staged


def ranked_candidates(articles: DataFrame) -> DataFrame:
    """Accepted members with text and vector, with ``distance`` to their story's centroid and ``source_rank`` by it, then date, then id."""
    fit = accepted(articles).where(F.col("embedding").isNotNull() & F.coalesce("body", F.lit("")).rlike(r"\S"))
    scored = fit.join(centroids(articles), "story_id").withColumn("distance", cosine_distance(F.col("embedding"), F.col("centroid"))).drop("centroid")
    return scored.withColumn("source_rank", F.row_number().over(Window.partitionBy("story_id").orderBy(F.round("distance", 9), "published_at", "id")))


def capped(ranked: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The first by rank with at most two a publisher: the set-based part of the selection, without endpoints and near-duplicates."""
    own = F.row_number().over(Window.partitionBy("story_id", "publisher_id").orderBy("source_rank"))
    return ranked.withColumn("publisher_rank", own).where((F.col("publisher_rank") <= cfg.evidence_per_publisher)).withColumn("pick", F.row_number().over(Window.partitionBy("story_id").orderBy("source_rank"))).where(F.col("pick") <= cfg.evidence_max)


def near_duplicate_pairs(ranked: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(story_id, a, b), a < b, whose vectors are closer than the threshold allows; compared in blocks of bounded size."""
    found = similar_pairs(ranked, cfg.near_duplicate, "story_id").where(F.col("similarity") > cfg.near_duplicate)
    return found.select(F.col("g").alias("story_id"), "a", "b")


#: Reports of a story that one round looks at, in order of rank.
POOL = 64


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` of each story; cut before the shuffle too."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(*order))).where(F.col("k") <= k).drop("k")


def _takeable(rows: DataFrame, held: DataFrame, sizes: DataFrame, total: int, cfg: Config, per_publisher: int | None = None) -> DataFrame:
    """Rows of the stories in ``held`` that are not held, nearly equal no held one and keep within the publisher's share."""
    state = held.groupBy("story_id").agg(F.collect_list(F.struct("id", "publisher_id", "embedding")).alias("held")).join(sizes, "story_id")
    met = joined_by_count(rows, state, ["story_id"], total)
    if per_publisher is not None:
        met = met.where(F.size(F.filter("held", lambda h: h["publisher_id"].eqNullSafe(F.col("publisher_id")))) < per_publisher)
    taken = F.exists("held", lambda h: (h["id"] == F.col("id")) | (cosine(F.col("embedding"), h["embedding"]) > cfg.near_duplicate))
    return met.where(~taken).select(*rows.columns)


def select_evidence(ranked: DataFrame, cfg: Config = DEFAULT, pool: int = POOL) -> DataFrame:
    """(story_id, id, evidence_id, reason, source_rank): the bounded greedy pick of each story.

    The earliest report first, then the latest that can be taken, then by rank, two a publisher; nothing that nearly equals a held one.

    All stories are worked on at once and no story gathers in one task: the two endpoints are one pass each, the rest is picked from
    the ``pool`` first by rank of those that can still be taken.  A story whose pool was full but gave too few goes through another
    round with what it holds; each round takes one report at least, so there are ``evidence_max`` at most, and usually one.
    """
    rows = staged(ranked.select("story_id", "id", "publisher_id", "published_at", "source_rank", "embedding"), "ranked")
    sizes = staged(rows.groupBy("story_id").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    columns = [*rows.columns, "reason"]
    earliest = staged(_first(rows, 1, F.asc_nulls_last("published_at"), F.asc("id")).withColumn("reason", F.lit("earliest_reporting")), "earliest")
    free = _takeable(rows, earliest, sizes, total, cfg)
    latest = _first(free, 1, F.desc_nulls_first("published_at"), F.desc("id")).withColumn("reason", F.lit("latest_reporting"))
    held = staged(earliest.select(*columns).unionByName(latest.select(*columns)), "held")
    kinds = dict(held.dtypes)

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source_rank").reset_index(drop=True)
        v = np.array(part.embedding.tolist(), np.float64)
        norm = np.linalg.norm(v, axis=1)
        unit = v / np.where(norm == 0, np.inf, norm)[:, None]
        near = unit @ unit.T > cfg.near_duplicate
        publisher, reason = part.publisher_id.where(part.publisher_id.notna(), None).tolist(), part.reason.where(part.reason.notna(), None).tolist()
        taken = [i for i, r in enumerate(reason) if r]
        asked = [i for i, r in enumerate(reason) if not r]
        for i in asked:
            if len(taken) >= cfg.evidence_max:
                break
            if not near[i, taken].any() and sum(publisher[t] == publisher[i] for t in taken) < cfg.evidence_per_publisher:
                taken.append(i)
                reason[i] = "centroid_rank"
        again = len(taken) < cfg.evidence_max and len(asked) == pool
        return part.assign(reason=reason, again=again).iloc[taken]

    chosen = []
    while True:
        free = _takeable(rows, held, sizes, total, cfg, cfg.evidence_per_publisher)
        asked = _first(free, pool, F.asc("source_rank")).withColumn("reason", F.lit(None).cast("string"))
        state = held.unionByName(asked.select(*columns)).groupBy("story_id")
        found = staged(state.applyInPandas(pick, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", again boolean"), "held")
        chosen.append(found.where("not again").select("story_id", "id", "reason", "source_rank"))
        held = found.where("again").select(*columns)
        if held.isEmpty():
            break
    out = functools.reduce(DataFrame.unionByName, chosen)
    number = F.row_number().over(Window.partitionBy("story_id").orderBy("source_rank"))
    return out.select("story_id", "id", F.concat(F.lit("A"), number.cast("string")).alias("evidence_id"), "reason", "source_rank")


def with_excerpts(selected: DataFrame, articles: DataFrame) -> DataFrame:
    return selected.join(articles.select("id", "title", "body", "mode", "publisher_id", "published_at"), "id").withColumns({"excerpt": excerpt(F.col("body"), DEFAULT.excerpt_chars), "content_hash": content_hash(F.col("body"))})


def evidence_from_articles(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Evidence of a list of hits (set_id, ids): hit order is rank; a missing body gives way to the title."""
    each = ids.select("set_id", F.posexplode("ids").alias("pos", "id"))
    met = each.join(articles, "id").withColumn("body", F.coalesce("body", "title"))
    return met.withColumn("evidence_id", F.concat(F.lit("A"), F.row_number().over(Window.partitionBy("set_id").orderBy("pos")).cast("string")))


def frozen_sets(evidence: DataFrame) -> DataFrame:
    """(story_id, set_hash, article_count, publishers, weakest_mode) of excerpted evidence: the hash covers each row in rank order."""
    line = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("evidence_id", "id", "publisher_id", "title", "excerpt", "content_hash", "mode", "reason")]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("source_rank", line.alias("line")))), lambda x: x["line"])
    sets = evidence.groupBy("story_id").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("set_hash"), F.count("*").cast("int").alias("article_count"), F.countDistinct("publisher_id").cast("int").alias("publishers"))
    return sets.join(weakest_mode(evidence, "story_id"), "story_id")


def frozen_changed(frozen: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, changed): whether an article of a frozen set is gone, has left the story or reads differently."""
    now = accepted(articles).select("id", F.col("story_id").alias("now_story"), content_hash(F.col("body")).alias("now_hash"))
    met = frozen.join(now, "id", "left")
    same = F.coalesce((F.col("now_story") == F.col("story_id")) & (F.col("now_hash") == F.col("content_hash")), F.lit(False))
    return met.groupBy("story_id").agg(F.some(~same).alias("changed"))


def may_serve(terms_class: Column, mode: Column) -> Column:
    return (terms_class == "licensed") | ((terms_class == "syndicated_excerpt") & (mode == "feed_excerpt"))


def servable(text: Column, terms_class: Column, mode: Column) -> Column:
    """The text where the publisher's terms clear the mode, else null."""
    return F.when(may_serve(terms_class, mode), text)
