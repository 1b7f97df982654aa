import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ingest
from tidewire.sources.keyed import KeyedTable
from tidewire.streaming import streams, windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stamp(k):
    return (T0 + k * windows.QUARTER).strftime(windows.STAMP)


def publish(folder, k, lines=None):
    """The archive of window ``k``, none for ``lines`` = None, and a listing that names it."""
    if lines is not None:
        with zipfile.ZipFile(folder / f"{stamp(k)}.gkg.csv.zip", "w") as z:
            z.writestr(f"{stamp(k)}.gkg.csv", "\n".join(lines) + "\n")
    (folder / windows.LISTING).write_text(f"1 abc http://host/{stamp(k)}.export.CSV.zip\n2 abc http://host/{stamp(k)}{windows.ENDING}\n")


def run(spark, folder, checkpoint, into, **options):
    def keep(batch, _):
        into.extend((r.window, r.status, r.value) for r in batch.collect())

    query = windows.quarter_hours(spark, str(folder), **options).writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_windows_are_healed_after_a_restart(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    publish(folder, 3, ["old"])
    publish(folder, 4, ["a", "b"])
    run(spark, folder, tmp_path / "c", seen)
    assert seen == [(stamp(4), "line", "a"), (stamp(4), "line", "b")]  # a first start goes live
    seen.clear()
    run(spark, folder, tmp_path / "c", seen)
    assert seen == []
    for k, lines in ((5, ["c"]), (6, None), (7, ["d"])):
        publish(folder, k, lines)
    run(spark, folder, tmp_path / "c", seen)
    assert sorted(seen) == [(stamp(5), "line", "c"), (stamp(6), "failed", "no such archive"), (stamp(7), "line", "d")]


def test_a_long_gap_is_stated_and_not_read(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for k in range(0, 30):
        publish(folder, k, [f"w{k}"])
    run(spark, folder, tmp_path / "c", seen, cursor=stamp(20))  # nine windows, of which eight are missed
    assert sorted(seen) == [(stamp(k), "line", f"w{k}") for k in range(21, 30)]
    seen.clear()
    run(spark, folder, tmp_path / "d", seen, cursor=stamp(19))
    assert sorted(seen) == [(stamp(29), "line", "w29"), (stamp(29), "skipped", "9")]
    rows = spark.createDataFrame(seen, "window string, status string, value string")
    assert [(r.window, r.lines, r.failure, r.skipped) for r in windows.window_runs(rows).collect()] == [(stamp(29), 1, None, 9)]


def test_offsets_agree_with_the_catch_up_plan(spark):
    cases = [(None, 40)] + [(c, n) for c in (0, 7, 31, 40, 44) for n in (40, 41)]
    frame = spark.createDataFrame([(i, None if c is None else T0 + c * windows.QUARTER + timedelta(seconds=100 * (i % 3)), T0 + n * windows.QUARTER) for i, (c, n) in enumerate(cases)], "i int, cursor timestamp, current timestamp")
    for r in ingest.catch_up(frame).select("i", F.transform("windows", lambda w: F.date_format(w, "yyyyMMddHHmmss")).alias("stamps"), "skipped", F.date_format("cursor", "yyyyMMddHHmmss").alias("c"), F.date_format("current", "yyyyMMddHHmmss").alias("n")).collect():
        assert windows.planned(r.c, r.n) == (r.stamps, r.skipped)


def test_broken_archives_and_listings(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    publish(folder, 2)
    (folder / f"{stamp(2)}{windows.ENDING}").write_bytes(b"no archive")
    run(spark, folder, tmp_path / "c", seen)
    assert seen == [(stamp(2), "failed", "not an archive")]
    (folder / windows.LISTING).write_text("nothing")
    with pytest.raises(ValueError, match="no window"):
        windows.newest(str(folder))
    with pytest.raises(ValueError, match="stamp"):
        windows.at("2024")


SIGHTING = "url string, title string, domain string, mode string, body string, tone double, published_at timestamp"


def sightings(spark, rows):
    return spark.createDataFrame([(u, t, "a.example", m, b, tone, T0 + timedelta(hours=h)) for u, t, m, b, tone, h in rows], SIGHTING)


def test_enrichment_in_place_equals_the_whole_log(spark, tmp_path):
    batches = [
        [("u1", "a.example", "metadata_only", "short", None, 1), ("u2", "Name", "feed_excerpt", "held", None, 1), ("u1", "Better", "metadata_only", "same", None, 2)],
        [("u1", "Name", "feed_excerpt", "long", 2.5, 3), ("u2", "Other", "metadata_only", "weak", None, 3), ("u3", "New", "feed_excerpt", "x", None, 3)],
        [("u1", "Late", "licensed_full_text", "whole", 9.0, 4), ("u3", "New", "api_content", "y", 1.0, 4), ("u3", "New", "api_content", "z", 2.0, 5)],
    ]
    path, log = str(tmp_path / "held"), str(tmp_path / "log")
    sink, logged = streams.enrich_into(path, buckets=4), streams.sightings_into(log)
    for number, rows in enumerate(batches):
        for _ in range(2):  # each batch comes twice
            sink(sightings(spark, rows), number)
        logged(sightings(spark, rows), number)
        told = lambda frame: sorted((r.url, r.title, r["mode"], r.body, r.tone, r.climbed, r.sightings) for r in frame.collect())
        assert told(KeyedTable(spark, path).read()) == told(streams.enriched_articles(spark, log))


def test_a_killed_enrichment_leaves_the_batch_before_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "held")
    streams.enrich_into(path)(sightings(spark, [("u1", "T", "metadata_only", "short", None, 1)]), 0)
    again = sightings(spark, [("u1", "T", "feed_excerpt", "long", None, 2)])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            streams.enrich_into(path)(again, 1)
    assert [r.body for r in KeyedTable(spark, path).read().collect()] == ["short"]
    streams.enrich_into(path)(again, 1)
    assert [r.body for r in KeyedTable(spark, path).read().collect()] == ["long"]


def test_expiry_by_the_time_of_storage(spark, tmp_path):
    """The clock moves with the rows that are stored; what expires is what the batch rule prunes."""
    folder = str(tmp_path / "in")
    day = lambda d: T0 + timedelta(days=d)
    stored = [(1, day(0), False), (2, day(0.5), False), (3, day(1), True), (4, day(2), False)]
    later = [(2, day(3), True), (5, day(7.2), False)]
    last = [(6, day(9.5), False)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gone = []
    try:
        for rows in (stored, later, last, [(7, day(9.6), False)]):
            spark.createDataFrame(rows, "id long, stored_at timestamp, keeps boolean").coalesce(1).write.mode("append").parquet(folder)
            stream = streams.expired_articles(spark.readStream.schema("id long, stored_at timestamp, keeps boolean").parquet(folder))
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).foreachBatch(lambda b, _: gone.extend((r.id, r.stored_at) for r in b.collect())).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    first = {i: (at, keeps) for i, at, keeps in stored + [later[1]] + last}
    articles = spark.createDataFrame([(i, "feed_excerpt" if keeps or i == 2 else "metadata_only", None, at, None) for i, (at, keeps) in first.items()], "id long, mode string, story_id long, created_at timestamp, connector_id long")
    stay = ingest.pruned(articles, spark.createDataFrame([], "connector_id long, kind string"), spark.createDataFrame([], "article_id long"), F.lit(day(9.5)))
    assert {i for i, _ in gone} == set(first) - {r.id for r in stay.collect()} == {1, 4} and dict(gone)[1].replace(tzinfo=timezone.utc) == day(0)
