"""Schemas of the tables, as DDL; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCATION = "struct<featureId:string,countryCode:string,latitude:double,longitude:double>"

TABLES = {
    "publishers": "publisher_id string, name string, domain string, terms_class string, leaning string, leaning_source string",
    "stories": "story_id string, slug string, title string, summary string, category string, centroid array<float>, first_seen_at timestamp, last_seen_at timestamp",
    "articles": "id string, url string, publisher_id string, connector_id string, title string, body string, mode string, tone double, published_at timestamp, created_at timestamp, "
    "extraction_attempted_at timestamp, embedding array<float>, story_id string, status string, score double",
    "annotations": f"article_id string, kind string, surface_name string, char_offset int, location_detail {LOCATION}",
    "connectors": "connector_id string, name string, kind string, feed_provides_full_text boolean",
    "ingestion_runs": "run_id string, connector_id string, status string, discovered int, inserted int, enriched int, duplicate int, rejected_by_policy int, failed int, messages array<string>, cursor string, started_at timestamp",
    "clustering_runs": "run_id string, status string, considered int, assigned int, held_for_review int, seeded int, unclustered int, stories_created int, started_at timestamp",
    "rejected_story_assignments": "id string, story_id string, rejected_at timestamp",
    "story_merge_records": "survivor string, merged string, refusal string, article_ids array<string>, merged_at timestamp",
    "entities": "id string, kind string, name string, feature_key string, canonical_name string, ticker string, articles int",
    "entity_edges": "a string, b string, article_id string",
    "entity_aliases": "kind string, name string, feature_key string, target string",
    "entity_merge_proposals": "id string, kind string, feature_key string, survivor string, merged string, similarity float",
    "entity_merge_refusals": "kind string, feature_key string, name_a string, name_b string",
    "evidence_sets": "set_id string, story_id string, set_hash string, article_count int, publishers int, weakest_mode string, frozen_at timestamp",
    "evidence_set_articles": "set_id string, evidence_id string, article_id string, publisher_id string, reason string, source_rank int, title string, excerpt string, content_hash string, mode string",
    "generation_runs": "run_id string, story_id string, lens string, prompt_version string, provider string, model string, set_hash string, status string, failure_code string, completed_at timestamp",
    "analysis_claims": "run_id string, claim_index int, claim_type string, text string",
    "claim_evidence": "run_id string, claim_index int, evidence_id string, relationship string",
    "prompt_templates": "version string, tone string, lens_emphasis string, claim_min int, claim_max int, surfaced array<string>, is_current boolean",
    "intelligence_briefs": "brief_id string, owner string, title string, category string, capacity int, created_at timestamp, updated_at timestamp",
    "brief_articles": "brief_id string, article_id string",
    "flashcards": "card_id string, owner string, claim_id string, question string, answer string, repetitions int, ease double, days int, due_at timestamp",
    "flashcard_reviews": "card_id string, review_id string, reviewed_at timestamp, grade int",
    "watchlist_items": "owner string, kind string, value string",
    "users": "id string, email string, role string, active boolean, created_at timestamp",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
