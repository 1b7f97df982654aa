"""Identity, duplicates, enrichment and ledgers of incoming articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import FIXTURE_MODE, MODE_LADDER
from tidewire.functions.text import normalize_title
from tidewire.functions.urls import canonical_url, publisher_domain, suffixes


def mode_rank(mode: Column) -> Column:
    """The rung of a text mode; null off the ladder."""
    rank = F.lit(None).cast("int")
    for i, m in enumerate(MODE_LADDER):
        rank = F.when(mode == m, i).otherwise(rank)
    return rank


def evidence_rank(mode: Column) -> Column:
    return F.when(mode == FIXTURE_MODE, 3).otherwise(mode_rank(mode))


def is_stronger(new: Column, held: Column) -> Column:
    """Strictly stronger, both on the ladder."""
    return F.coalesce(mode_rank(new) > mode_rank(held), F.lit(False))


def weakest_mode(rows: DataFrame, group: str, mode: str = "mode") -> DataFrame:
    """(group, weakest_mode): the least evidence rank, ties in ladder order."""
    order = evidence_rank(F.col(mode)) * 10 + F.when(F.col(mode) == FIXTURE_MODE, 4).otherwise(mode_rank(F.col(mode)))
    return rows.groupBy(group).agg(F.coalesce(F.min_by(mode, order), F.lit("metadata_only")).alias("weakest_mode"))


def validated(items: DataFrame) -> DataFrame:
    """Items (title, link, published_at, mode, body, source_domain, failure) with ``url`` and the first ``failure`` that holds."""
    url = canonical_url(F.col("link"))
    domain = F.coalesce(F.lower("source_domain"), publisher_domain(url))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    document = publisher_domain(url)
    failure = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(blank("title"), "no title")
        .when(blank("link"), "no link")
        .when(url.isNull(), "bad url")
        .when(F.col("published_at").isNull(), "no date")
        .when((F.col("mode") != "metadata_only") & F.col("body").isNull(), "no text")
        .when(~domain.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), "bad source domain")
        .when((document != domain) & ~document.endswith(F.concat(F.lit("."), domain)), "source and document unrelated")
    )
    return items.withColumns({"url": url, "domain": domain, "failure": failure})


def duplicate_pairs(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """(url, duplicate_of): same UTC day and normalised title, related domains, another URL; the least held URL.

    Domains are related if one is the other or lies under it, so they meet by equality: the new domain with each held one and what it lies under, and what
    the new one lies under with each held one.  Of the held URLs of a day, title and domain only the two least are kept, before anything is joined: one of them is
    another URL.  So a title that very many articles share on a day costs a row an article.
    """
    keyed = lambda df: df.select("url", F.col("domain"), F.to_date("published_at").alias("day"), normalize_title(F.col("title")).alias("key")).where("key <> '' and url is not null and domain is not null")
    on = ["day", "key", "domain"]

    def least(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*on).agg(F.min("url").alias("first"), F.max("url").alias("last"))
        rest = rows.join(first.where("first <> last"), on).where("url <> first").groupBy(*on).agg(F.min("url").alias("second"))
        return first.join(rest, on, "left").select(*on, "first", "second")

    new, old = keyed(incoming), keyed(held).distinct()
    whole = new.join(least(old.withColumn("domain", F.explode(suffixes(F.col("domain")))).distinct()), on)
    above = new.withColumn("domain", F.explode(F.slice(suffixes(F.col("domain")), F.lit(2), F.size(suffixes(F.col("domain")))))).join(least(old), on)
    met = whole.unionByName(above).withColumn("other", F.when(F.col("first") != F.col("url"), F.col("first")).otherwise(F.col("second")))
    return met.where("other is not null").groupBy("url").agg(F.min("other").alias("duplicate_of"))


def reconciled(sightings: DataFrame) -> DataFrame:
    """One row for each URL from its sightings (url, seq, title, domain, mode, body, tone), the first of which is held.

    Text, with its mode, comes from the strongest sighting, the earliest of equals, so it only climbs; ``climbed`` says that the held vector
    and a pending assignment are void.  Tone is the first that is known.  The name improves only while it equals the domain.
    """
    rank, off = F.coalesce(mode_rank(F.col("mode")), F.lit(-1)), mode_rank(F.col("mode")).isNull()
    first = lambda c: F.min_by(c, "seq")
    rows = sightings.withColumns({"rank": rank, "off": off, "strength": F.struct(rank.alias("r"), (-F.col("seq")).alias("s"))})
    out = rows.groupBy("url").agg(
        first("title").alias("first_title"), first("domain").alias("domain"), first("mode").alias("first_mode"), first("body").alias("first_body"), first("off").alias("held_off"), first("rank").alias("first_rank"),
        F.max_by("mode", "strength").alias("best_mode"), F.max_by("body", "strength").alias("best_body"), F.max("rank").alias("best_rank"),
        F.min_by("tone", F.when(F.col("tone").isNotNull(), F.col("seq"))).alias("tone"), F.min_by("title", F.when(F.col("title") != F.col("domain"), F.col("seq"))).alias("good_title"), F.count(F.lit(1)).alias("sightings"),
    )
    climbed = ~F.col("held_off") & (F.col("best_rank") > F.col("first_rank"))
    title = F.when(F.col("first_title") == F.col("domain"), F.coalesce("good_title", "first_title")).otherwise(F.col("first_title"))
    return out.select(
        "url", title.alias("title"), "domain", F.when(climbed, F.col("best_mode")).otherwise(F.col("first_mode")).alias("mode"),
        F.when(climbed, F.col("best_body")).otherwise(F.col("first_body")).alias("body"), "tone", climbed.alias("climbed"), F.col("sightings").cast("int").alias("sightings"),
    )


def outcomes(incoming: DataFrame, held: DataFrame, staged_urls: DataFrame) -> DataFrame:
    """(url, outcome) of validated items (url, failure, mode, tone): failed, inserted, enriched or duplicate.

    A held URL is enriched if its text climbs, a missing tone is filled or new annotations were staged for it.
    """
    now = incoming.groupBy("url").agg(F.min("failure").alias("failure"), F.max_by("mode", mode_rank(F.col("mode"))).alias("mode"), F.max("tone").alias("tone"))
    was = held.select("url", F.col("mode").alias("held_mode"), F.col("tone").alias("held_tone"), F.lit(True).alias("held"))
    marked = staged_urls.select("url").distinct().withColumn("annotated", F.lit(True))
    met = now.join(was, "url", "left").join(marked, "url", "left")
    richer = is_stronger(F.col("mode"), F.col("held_mode")) | (F.col("held_tone").isNull() & F.col("tone").isNotNull()) | F.coalesce("annotated", F.lit(False))
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("held").isNull(), "inserted").when(richer, "enriched").otherwise("duplicate")
    return met.select("url", outcome.alias("outcome"))


def run_ledger(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts of each run's outcomes (run, outcome, failure), with at most five distinct messages."""
    count = lambda o: F.count_if(F.col("outcome") == o).cast("int").alias(o)
    return rows.groupBy(run).agg(
        F.count(F.lit(1)).cast("int").alias("discovered"), count("inserted"), count("enriched"), count("duplicate"), F.lit(0).alias("rejected_by_policy"), count("failed"),
        F.slice(F.array_sort(F.collect_set("failure")), 1, 5).alias("messages"),
    )


def staged_annotations(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """The occurrences that are not held yet, each once, by article, kind, offset and the name's digest."""
    key = lambda df: df.withColumn("name_key", F.md5("surface_name"))
    on = ["article_id", "kind", "char_offset", "name_key"]
    return key(incoming).dropDuplicates(on).join(key(held).select(*on), on, "left_anti").drop("name_key")


def extraction_backlog(articles: DataFrame, connectors: DataFrame, publishers: DataFrame, attempts: int = 20) -> DataFrame:
    """Feed excerpts worth a look at their pages, newest first, one more than the attempts so that a rest is noticed."""
    rss = connectors.where("kind = 'rss' and not coalesce(feed_provides_full_text, false)").select("connector_id")
    open_terms = publishers.where(F.col("terms_class") == "licensed").select("publisher_id")
    chosen = articles.where("mode = 'feed_excerpt' and extraction_attempted_at is null").join(rss, "connector_id", "left_semi").join(open_terms, "publisher_id", "left_semi")
    return chosen.orderBy(F.desc("published_at"), "id").limit(attempts + 1)


def new_publishers(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Domains without a publisher yet, each once."""
    return incoming.select("domain").where("domain is not null").distinct().join(held.select("domain"), "domain", "left_anti")


def catch_up(cursors: DataFrame, windows: int = 8) -> DataFrame:
    """(cursor, current) -> windows to load and how many were skipped, on the quarter-hour grid."""
    quarter = F.expr("interval 15 minutes")
    snapped = F.timestamp_seconds(F.floor(F.unix_timestamp("cursor") / 900) * 900)
    missed = ((F.unix_timestamp("current") - F.unix_timestamp(snapped)) / 900 - 1).cast("int")
    none, only = F.array().cast("array<timestamp>"), F.array("current")
    plan = F.when(F.col("cursor").isNull(), only).when(missed < 0, none).when(missed > windows, only).otherwise(F.sequence(F.least(snapped + quarter, F.col("current")), "current", quarter))
    return cursors.withColumns({"windows": plan, "skipped": F.when(missed > windows, missed).otherwise(0)})


def read_cursor(runs: DataFrame, connector: str = "connector_id") -> DataFrame:
    """The latest stamp on the grid among each connector's succeeded runs; malformed stamps are passed over."""
    at = F.when(F.col("cursor").rlike(r"^\d{14}$"), F.try_to_timestamp("cursor", F.lit("yyyyMMddHHmmss")))
    good = runs.where("status = 'succeeded'").withColumn("at", at).where(F.col("at").isNotNull() & (F.unix_timestamp("at") % 900 == 0))
    return good.groupBy(connector).agg(F.max_by("cursor", "at").alias("cursor"))


def advanced_cursor(windows: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, cursor, loaded, status): the cursor stops before the first failed window, later windows still count as loaded."""
    stopped = F.min(F.when(F.col("failed"), F.col("stamp"))).over(Window.partitionBy(run))
    rows = windows.withColumn("stop", stopped)
    return rows.groupBy(run).agg(
        F.max(F.when(F.col("stop").isNull() | (F.col("stamp") < F.col("stop")), F.col("stamp"))).alias("cursor"),
        F.count_if(~F.col("failed")).cast("int").alias("loaded"),
        F.when(F.every("failed"), F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
    )


def pruned(articles: DataFrame, connectors: DataFrame, brief_articles: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The articles that stay: only old metadata from window or list connectors (or none), outside stories and briefs, goes."""
    window = connectors.where(F.col("kind").isin("gdelt_gkg", "gdelt_doc")).select("connector_id", F.lit(True).alias("windowed"))
    kept = brief_articles.select(F.col("article_id").alias("id"), F.lit(True).alias("in_brief")).distinct()
    met = articles.join(window, "connector_id", "left").join(kept, "id", "left")
    old = (F.col("created_at") < now - F.make_dt_interval(F.lit(days))) & (F.col("mode") == "metadata_only")
    goes = old & (F.col("connector_id").isNull() | F.coalesce("windowed", F.lit(False))) & F.col("story_id").isNull() & F.col("in_brief").isNull()
    return met.where(~F.coalesce(goes, F.lit(False))).select(*articles.columns)
