from datetime import datetime, timedelta


from tidewire.operators import study
from tidewire.sources import feeds
from tidewire.streaming import streams


def window_file(folder, name, rows):
    lines = []
    for url, minute in rows:
        cells = [""] * feeds.FIELDS
        for k, v in {"record": url, "seen": f"202401010{minute // 60}{minute % 60:02d}00", "domain": "a.example", "url": url}.items():
            cells[feeds.GKG[k]] = v
        lines.append("\t".join(cells))
    (folder / name).write_text("\n".join(lines) + "\n")


def run(df, path, **kw):
    q = df.writeStream.option("checkpointLocation", str(path)).trigger(availableNow=True)
    for k, v in kw.items():
        q = getattr(q, k)(v)
    q.start().awaitTermination(120)


def test_windows_upsert_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    window_file(folder, "1.csv", [("u1", 0), ("u2", 1), ("u1", 2)])
    rows = lambda: streams.distinct_articles(streams.window_stream(spark, str(folder))).select("url", "domain", "seen_at")
    table = str(tmp_path / "table")
    run(rows(), tmp_path / "c", foreachBatch=streams.upsert_into(table, ["url"]))
    window_file(folder, "2.csv", [("u2", 16), ("u3", 17)])
    run(rows(), tmp_path / "c", foreachBatch=streams.upsert_into(table, ["url"]))
    assert sorted(r.url for r in spark.read.parquet(table).collect()) == ["u1", "u2", "u3"]


def test_later_sightings_enrich_the_held_article(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    schema = "url string, title string, domain string, mode string, body string, tone double, published_at timestamp"
    rows = lambda: spark.readStream.schema(schema).option("timestampFormat", "yyyy-MM-dd").json(str(folder))
    line = '{"url": "%s", "title": "%s", "domain": "a.example", "mode": "%s", "body": "%s", "published_at": "2024-01-0%d"%s}\n'
    (folder / "1.json").write_text(line % ("u1", "a.example", "metadata_only", "short", 1, "") + line % ("u2", "Name", "feed_excerpt", "held", 1, ""))
    run(rows(), tmp_path / "c", foreachBatch=streams.sightings_into(log))
    (folder / "2.json").write_text(line % ("u1", "Name", "feed_excerpt", "long", 2, ', "tone": 2.5') + line % ("u2", "Other", "metadata_only", "weak", 2, "") + line % ("u3", "New", "feed_excerpt", "x", 2, ""))
    run(rows(), tmp_path / "c", foreachBatch=streams.sightings_into(log))
    seen = lambda: {r.url: (r.title, r.mode, r.body, r.tone, r.climbed, r.sightings) for r in streams.enriched_articles(spark, log).collect()}
    want = {"u1": ("Name", "feed_excerpt", "long", 2.5, True, 2), "u2": ("Name", "feed_excerpt", "held", None, False, 2), "u3": ("New", "feed_excerpt", "x", None, False, 1)}
    assert seen() == want
    batch = spark.read.schema(schema).json(str(folder / "2.json"))
    streams.sightings_into(log)(batch, 1)
    assert seen() == want


def test_volume_waits_for_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    window_file(folder, "1.csv", [("u1", 0), ("u2", 1), ("u3", 16)])
    run(streams.volume_stream(streams.window_stream(spark, str(folder)), "0 seconds"), tmp_path / "c", format="memory", queryName="volume", outputMode="append")
    assert [r.n for r in spark.table("volume").collect()] == [2]


def test_card_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    log = [(c, i, datetime(2024, 1, 1) + timedelta(days=i), (c * 7 + i) % 6) for c in range(4) for i in range(6)]
    rows = spark.createDataFrame(log, "card_id long, review_id long, reviewed_at timestamp, grade int")
    want = {r.card_id: (r.repetitions, round(r.ease, 6), r.days) for r in study.card_states(rows).collect()}
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.card_id] = (r.repetitions, round(r.ease, 6), r.days)

    for part in ("review_id < 3", "review_id >= 3"):
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
        run(streams.card_stream(spark.readStream.schema(rows.schema).parquet(folder)), tmp_path / "c", foreachBatch=keep, outputMode="update")
    assert seen == want


def test_annotations_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    window_file(folder, "1.csv", [("u1", 0)])
    assert streams.annotation_rows(streams.window_stream(spark, str(folder))).isStreaming
