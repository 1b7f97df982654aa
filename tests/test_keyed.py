import pytest
from pyspark.sql import functions as F

from tidewire.sources.keyed import Conflict, KeyedTable

LATEST = lambda held, rows: held.unionByName(rows).groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def table_of(spark, path, buckets=8):
    schema = spark.createDataFrame([], "key string, value double, at long").schema
    return KeyedTable.create(spark, str(path), schema, ["key"], buckets)


def rows(spark, pairs, at):
    return spark.createDataFrame([(k, float(v), at) for k, v in pairs], "key string, value double, at long")


def held(table, **options):
    return {r.key: r.value for r in table.read(**options).collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    assert held(table) == {} and table.upsert(rows(spark, [(f"k{i}", i) for i in range(40)], 1), LATEST, ("w", 0))
    before = table.version()
    assert table.upsert(rows(spark, [("k3", 30), ("new", 1)], 2), LATEST, ("w", 1))
    after = table.version()
    assert held(table) == {f"k{i}": float(i) for i in range(40)} | {"k3": 30.0, "new": 1.0}
    changed = {b for b in after.files if after.files[b] != before.files.get(b)}
    assert 1 <= len(changed) <= 2 and held(table, version=before)["k3"] == 3.0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    table.upsert(rows(spark, [("a", 1)], 1), LATEST, ("w", 4))
    files = table.version().files
    assert not table.upsert(rows(spark, [("a", 2)], 2), LATEST, ("w", 4)) and not table.append(rows(spark, [("a", 2)], 2), ("w", 3))
    assert table.version().files == files and held(table) == {"a": 1.0}
    assert table.upsert(rows(spark, [("a", 2)], 2), LATEST, ("other", 0)) and held(table) == {"a": 2.0}


def test_a_killed_writer_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path / "t")
    table.upsert(rows(spark, [("a", 1), ("b", 1)], 1), LATEST, ("w", 0))

    def killed(version):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows(spark, [("a", 9)], 2), LATEST, ("w", 1))
    again = KeyedTable(spark, str(tmp_path / "t"))
    assert held(again) == {"a": 1.0, "b": 1.0}
    assert again.upsert(rows(spark, [("a", 9)], 2), LATEST, ("w", 1)) and held(again) == {"a": 9.0, "b": 1.0}
    assert again.vacuum() == 2 and held(again) == {"a": 9.0, "b": 1.0}  # the killed writer's files, and the bucket that was replaced
    assert again.vacuum() == 0


def test_of_two_writers_one_commits(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")

    def beaten(old, new):
        KeyedTable(spark, str(tmp_path / "t")).upsert(rows(spark, [("a", 5)], 1), LATEST)
        return LATEST(old, new)

    with pytest.raises(Conflict):
        table.upsert(rows(spark, [("a", 7)], 2), beaten)
    assert held(table) == {"a": 5.0}


def test_lookups_read_the_files_of_their_keys(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", 16)
    table.append(rows(spark, [(f"k{i}", i) for i in range(200)], 1))
    found = table.lookup([("k7",), ("k8",), ("none",)])
    assert {r.key for r in found.collect()} == {"k7", "k8"}
    assert len(found.inputFiles()) <= 3 < len(table.read().inputFiles())
    assert "PushedFilters: [Or" in found._jdf.queryExecution().executedPlan().toString() or "In(key" in found._jdf.queryExecution().executedPlan().toString()
    assert table.lookup([("none",)]).count() == 0 and table_of(spark, tmp_path / "empty").lookup([("k",)]).count() == 0
