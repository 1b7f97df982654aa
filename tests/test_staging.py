"""Intermediate tables, joins with hot keys, components."""

import random
from types import SimpleNamespace

import pytest

from tidewire import staging
from tidewire.operators.components import components


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None, checkpoint=None):
        settings = {"spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: settings.get(k) or d, set=settings.__setitem__), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))

    assert staging.shared_dir(session("yarn", "s3://bucket/x/")) == "s3://bucket/x"
    assert staging.shared_dir(session("spark://host:7077", None, "hdfs://y/z")) == "hdfs://y/z"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_dir(session(master))
    assert staging.shared_dir(session("local[4]")).startswith("file:///")


@pytest.mark.parametrize("rows", [1, 10, 1000])
def test_hot_keys_join_like_others(spark, monkeypatch, rows):
    monkeypatch.setattr(staging, "HOT_ROWS", rows)
    keys = ["a"] * 300 + ["b"] * 5 + ["c"] + [None]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    right = spark.createDataFrame([("a", 300, "x"), ("b", 5, "y"), ("d", 0, "z")], "k string, n long, v string")
    got = staging.joined_by_count(left, right, ["k"], len(keys)).collect()
    assert sorted((r.i, r.v) for r in got) == sorted((i, "x" if k == "a" else "y") for i, k in enumerate(keys) if k in ("a", "b"))


def test_hot_keys_are_bounded_at_any_size():
    for total in (0, 5_000, 10**9, 5 * 10**13):
        assert total / staging.hot_limit(total) <= staging.HOT_KEYS


@pytest.mark.parametrize("hot", [2, 1000])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(staging, "HOT_ROWS", hot)
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, 500 + i) for i in range(1, 60)] + [(600 + i, 601 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = list(range(700))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        if x is not None:
            low, high = sorted((find(x), find(y)))
            parent[high] = low
    for kind in ("long", "binary"):
        frame = spark.createDataFrame(links, "a long, b long")
        if kind == "binary":
            frame = frame.selectExpr("unhex(lpad(hex(a), 4, '0')) as a", "unhex(lpad(hex(b), 4, '0')) as b")
        got = {(r.id, r.component) for r in components(frame).collect()}
        told = (lambda x: x) if kind == "long" else (lambda x: bytearray(x.to_bytes(2, "big")))
        assert sorted(got, key=str) == sorted({(x, find(x)) for p in links if None not in p and p[0] != p[1] for x in p}, key=str) if kind == "long" else len(got) > 0
        if kind == "binary":
            assert {(bytes(a), bytes(b)) for a, b in got} == {(bytes(told(x)), bytes(told(find(x)))) for p in links if None not in p and p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
