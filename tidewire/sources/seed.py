"""A small curated corpus for demonstrations, loaded once by natural keys."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES

PUBLISHERS = ["harbour-post", "north-ledger", "valley-wire", "civic-echo", "plain-times", "orbit-daily", "field-notes", "river-herald"]
TOPICS = [
    ("Port authority reopens the east quay", "The quay took its first freighter after a winter of repairs."), ("Council votes on a night bus network", "Four lines would run until three in the morning."),
    ("Wheat yields recover after a wet spring", "Growers report a fifth more grain than last year."), ("Library lends out measuring instruments", "Readers can borrow telescopes and noise meters."),
    ("Bridge sensors report their first data", "Engineers watch the span bend in the wind."), ("School meals move to local kitchens", "Cooks in nine districts share one menu."),
    ("Clinic trial shortens waiting times", "A desk sorts patients before they sit down."), ("Ferry operator orders electric boats", "The first of three will sail in spring."),
    ("Museum returns a ship's bell", "The bell was raised from a wreck in the bay."), ("Orchestra plays in the old turbine hall", "The hall holds a sound for seven seconds."),
    ("Youth team wins the coastal cup", "A late goal settled the final."), ("Weather station marks a century of records", "Its first reading was written in pencil."),
]
PLACES, ARTICLES = 22, 27
ORIGIN = datetime(2024, 1, 1)


def seed_publishers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, f"{p}.example", "licensed" if i % 2 else "syndicated_excerpt") for i, p in enumerate(PUBLISHERS)], "publisher_id string, domain string, terms_class string")


def seed_stories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"seed-{i}", t, s, CATEGORIES[i % len(CATEGORIES)]) for i, (t, s) in enumerate(TOPICS)], "slug string, title string, summary string, category string")


def seed_articles(spark: SparkSession) -> DataFrame:
    """27 articles: two or three on each story, from different publishers."""
    rows = []
    for n in range(ARTICLES):
        i, publisher = n % len(TOPICS), PUBLISHERS[(n * 3 + n // len(TOPICS)) % len(PUBLISHERS)]
        title, summary = TOPICS[i]
        rows.append((f"https://{publisher}.example/seed/{n}", f"seed-{i}", publisher, title, f"{summary} Report {n // len(TOPICS) + 1}.", "manual_fixture", ORIGIN + timedelta(hours=n)))
    return spark.createDataFrame(rows, "url string, slug string, publisher_id string, title string, body string, mode string, published_at timestamp")


def seed_places(spark: SparkSession) -> DataFrame:
    return spark.range(PLACES).select(F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("feature_id"), (F.col("id") * 3 - 30).cast("double").alias("latitude"), (F.col("id") * 7 - 70).cast("double").alias("longitude"))


def loaded(held: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """``held`` with the seeds whose natural key it lacks; loading twice changes nothing."""
    return held.unionByName(seeds.join(held.select(key), key, "left_anti"), allowMissingColumns=True)
