import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import search
from tidewire.operators.textindex import TextIndex

SCHEMA = "id long, title string, body string"


def index_of(spark, path, buckets=16):
    return TextIndex(spark, str(path), "id", "bigint", buckets)


def told(frame):
    return {(r.term, r.id): round(r.weight, 6) for r in frame.collect()}


def test_windows_add_up_and_replace(spark, tmp_path):
    index = index_of(spark, tmp_path)
    first = spark.createDataFrame([(1, "Storms hitting coasts", "the rain"), (2, "Rainy days", None), (2, "Rainy days", None)], SCHEMA)
    second = spark.createDataFrame([(2, "Storm", "storms and storms"), (3, "coast", None)], SCHEMA)
    assert index.add(first, 0, "title", "body") and index.add(second, 1, "title", "body")
    now = first.where("id = 1").union(second)
    want = told(search.postings(now, "id", "title", "body"))
    assert told(index.all()) == want and want["storm", 2] == 1.8
    assert not index.add(second, 1, "title", "body") and not index.add(first, 0, "title", "body") and told(index.all()) == want
    assert told(index.of(["coast", "none"])) == {k: v for k, v in want.items() if k[0] == "coast"}


def test_a_window_that_died_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    index = index_of(spark, tmp_path)
    index.add(spark.createDataFrame([(1, "storm", None)], SCHEMA), 0, "title", "body")
    later = spark.createDataFrame([(1, "rain", None), (2, "storm", None)], SCHEMA)

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(index.rows, "upsert", killed)
        with pytest.raises(KeyboardInterrupt):
            index.add(later, 1, "title", "body")
    assert told(index.all()) == {("storm", 1): 1.0}
    again = index_of(spark, tmp_path)
    assert again.add(later, 1, "title", "body") and told(again.all()) == {("rain", 1): 1.0, ("storm", 2): 1.0}


def test_a_query_opens_the_files_of_its_terms(spark, tmp_path):
    index = index_of(spark, tmp_path, 32)
    index.add(spark.createDataFrame([(i, f"word{i} common", None) for i in range(300)], SCHEMA), 0, "title", "body")
    found = index.postings.lookup([("word7",), ("common",)])
    buckets = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(buckets) <= 2 and len({f.split("bucket=")[1].split("/")[0] for f in index.postings.read().inputFiles()}) > 20
    assert "common" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_top_equals_the_full_sort(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["storm", "coast", "rain", "x1"], [1, 2, 3, 5], k=rng.randint(0, 6))), " ".join(["storm"] * rng.choice([0, 0, 1, 40]) + ["coast"] * rng.choice([0, 0, 2, 60]))) for i in range(400)]
    index = index_of(spark, tmp_path)
    index.add(spark.createDataFrame(rows, SCHEMA), 0, "title", "body")
    saved = False
    for terms in (["storm", "coast"], ["coast", "rain", "storm"], ["storm", "absent"]):
        full = search.matches(index.of(terms), "id", terms).orderBy(F.desc("rank"), "id")
        for k in (3, 1000):
            got, read = index.top(terms, k)
            assert [(r.id, round(r["rank"], 6)) for r in got.collect()] == [(r.id, round(r["rank"], 6)) for r in full.limit(k).collect()]
            assert read["read"] <= read["held"]
            saved |= read["read"] < read["held"] / 2
    assert saved and index.top([], 3)[0].count() == 0 and [r.id for r in index.search("The storms", 2).collect()] == [r.id for r in search.matches(index.of(["storm"]), "id", ["storm"]).orderBy(F.desc("rank"), "id").limit(2).collect()]


def test_each_distinct_word_is_stemmed_once(spark, monkeypatch):
    seen = []

    def counted(rows, *names):
        seen.append(rows.count())
        return stemmed(rows, *names)

    stemmed = search.stemmed
    monkeypatch.setattr(search, "stemmed", counted)
    rows = spark.createDataFrame([(i, "Storms hit", "storm storm storms") for i in range(700)], SCHEMA)
    got = told(search.postings(rows, "id", "title", "body"))
    assert seen == [3] and len(got) == 1400 and got["storm", 5] == 2.2 and got["hit", 5] == 1.0
