"""Physical plans: what reaches the scan, and which joins are planned."""

import re

import pytest
from pyspark.sql import functions as F

from tidewire.operators import graph, resolve
from tidewire.plans.contract import QUERIES

SF = "/root/testdata/sf0.001"
#: One-row frames meet without a key.
KEYLESS = {"graph_totals", "clustering_ledger", "resolution_ledger", "focus_neighbours", "edge_evidence", "drawn_scale", "search_page", "timeline_lanes"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - KEYLESS))
def test_joins_have_keys(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))


def test_scans_read_what_is_asked_for(spark):
    text = plan(QUERIES["content_hashes"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert not re.search("ReadSchema: struct<[^>]*embedding", plan(QUERIES["weakest_modes"](spark, SF)))


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(graph.samples(rows.select(F.lit("x").alias("a"), F.lit("y").alias("b"), F.col("o_orderkey").alias("article_id")), rows.where("o_custkey = 7").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_custkey,7\)", text)


def test_top_k_is_cut_early(spark):
    pairs = spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") % 11 + 7).alias("b"), F.col("id").alias("weight"))
    assert "WindowGroupLimit" in plan(resolve.bounded_pairs(pairs, 2))
    assert "TakeOrderedAndProject" in plan(QUERIES["semantic_search"](spark, SF))


def test_shared_trigrams_are_an_equi_join(spark):
    names = spark.createDataFrame([("person", "ann", "", 5), ("person", "anna", "", 6)], "kind string, name string, feature_key string, articles int")
    assert "NestedLoop" not in plan(resolve.merge_candidates(names))
