"""Spaced repetition: SM-2, decks, citation-valid cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import DEFAULT

FIRST_EASE, LEAST_EASE, PASS, FIRST_DAYS, SECOND_DAYS = 2.5, 1.3, 3, 1, 6
STATE = "struct<repetitions:int,ease:double,days:int>"


def sm2_step(state: Column, grade: Column) -> Column:
    """The state after a review: ease falls by the miss, never below its floor; the new interval uses the ease before this review."""
    miss = 5 - grade
    ease = F.greatest(F.lit(LEAST_EASE), state["ease"] + (0.1 - miss * (0.08 + miss * 0.02)))
    repetitions = F.when(grade < PASS, 0).otherwise(state["repetitions"] + 1)
    grown = F.greatest(state["days"] + 1, F.floor(state["days"] * state["ease"] + 0.5).cast("int"))
    days = F.when(grade < PASS, FIRST_DAYS).when(state["repetitions"] == 0, FIRST_DAYS).when(state["repetitions"] == 1, SECOND_DAYS).otherwise(grown)
    return F.struct(repetitions.cast("int").alias("repetitions"), ease.cast("double").alias("ease"), days.cast("int").alias("days"))


def card_states(reviews: DataFrame) -> DataFrame:
    """(card_id, repetitions, ease, days, reviews, last_at) from the log (card_id, review_id, reviewed_at, grade), in order."""
    log = reviews.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("reviewed_at", "review_id", "grade"))).alias("log"))
    start = F.struct(F.lit(0).alias("repetitions"), F.lit(FIRST_EASE).alias("ease"), F.lit(0).alias("days"))
    done = F.aggregate("log", start, lambda s, r: sm2_step(s, r["grade"]))
    return log.select("card_id", done.alias("s"), F.size("log").alias("reviews"), F.element_at("log", -1)["reviewed_at"].alias("last_at")).select("card_id", "s.repetitions", "s.ease", "s.days", "reviews", "last_at")


def due_at(reviewed_at: Column, days: Column) -> Column:
    return reviewed_at + F.make_dt_interval(days)


def citation_valid(cards: DataFrame, own_citations: DataFrame, claim_citations: DataFrame) -> DataFrame:
    """Cards that cite a frozen article themselves, or whose claim does."""
    a = cards.join(own_citations.select("card_id"), "card_id", "left_semi")
    b = cards.join(claim_citations.select("claim_id"), "claim_id", "left_semi")
    return a.unionByName(b).dropDuplicates(["card_id"])


def summary(cards: DataFrame, now: Column, by: str = "owner") -> DataFrame:
    """(owner, total, due, next_due)."""
    return cards.groupBy(by).agg(F.count("*").cast("int").alias("total"), F.count_if(F.col("due_at") <= now).cast("int").alias("due"), F.min(F.when(F.col("due_at") > now, F.col("due_at"))).alias("next_due"))


def session(cards: DataFrame, now: Column, limit: int = DEFAULT.session_limit) -> DataFrame:
    return cards.where(F.col("due_at") <= now).orderBy("due_at", "card_id").limit(limit)


def card_list(cards: DataFrame, text: str | None = None, status: str | None = None, now: Column | None = None) -> DataFrame:
    """Cards whose question or answer holds a text, in a status (due or later)."""
    out = cards
    if text:
        out = out.where(F.lower("question").contains(text.lower()) | F.lower("answer").contains(text.lower()))
    if status:
        out = out.where((F.col("due_at") <= now) if status == "due" else (F.col("due_at") > now))
    return out


def card_citations(cards: DataFrame, claim_citations: DataFrame, own_citations: DataFrame, articles: DataFrame) -> DataFrame:
    """(card_id, citations): titles by the claim's and the card's own citations, by title."""
    by_claim = cards.select("card_id", "claim_id").join(claim_citations.select("claim_id", "article_id"), "claim_id").select("card_id", "article_id")
    both = by_claim.unionByName(own_citations.select("card_id", "article_id"))
    rows = both.join(articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    return rows.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("title", "article_id"))).alias("citations"))


def question_key(claim_type: Column, text: Column) -> Column:
    return F.sha2(F.concat(claim_type, F.lit("\0"), text), 256)


def new_cards(claims: DataFrame, cards: DataFrame, citations: DataFrame, cache: DataFrame) -> DataFrame:
    """Cited claims (owner, claim_id, claim_type, text) without a card of that owner, with the cached question where there is one."""
    fresh = claims.join(citations.select("claim_id"), "claim_id", "left_semi").join(cards.select("owner", "claim_id"), ["owner", "claim_id"], "left_anti")
    return fresh.withColumn("key", question_key(F.col("claim_type"), F.col("text"))).join(cache.select("key", "question").dropDuplicates(["key"]), "key", "left")


def extended_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The question cache with new keys added; held ones stay as they are."""
    return cache.unionByName(new.select("key", "question").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))


def history(reviews: DataFrame, card: Column) -> DataFrame:
    return reviews.where(F.col("card_id") == card).orderBy(F.desc("reviewed_at"), F.desc("review_id"))
