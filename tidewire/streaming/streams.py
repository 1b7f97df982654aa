"""Structured Streaming: window files as a source, article upserts and enrichment, expiry, card states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.ingest import reconciled
from tidewire.operators.study import FIRST_DAYS, FIRST_EASE, LEAST_EASE, PASS, SECOND_DAYS
from tidewire.sources.feeds import annotations, gkg_rows
from tidewire.sources.keyed import KeyedTable


def window_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Rows of annotation windows as their files arrive; the checkpoint keeps the place, late files are taken when they come."""
    return gkg_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def distinct_articles(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each URL once while its state lasts."""
    return rows.where("not malformed").withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["url"])


def volume_stream(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Articles a quarter of an hour and domain."""
    return rows.where("not malformed").withWatermark("seen_at", late).groupBy(F.window("seen_at", "15 minutes"), "domain").agg(F.count("*").alias("n"))


def upsert_into(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that appends the rows whose key the Parquet table lacks; a repeated batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(key)
        try:
            held = batch.sparkSession.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(held.select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return run


def sightings_into(path: str, at: str = "published_at") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that logs every sighting of a URL, for ``enriched_articles``.

    A batch has a folder of its own, so a repeated batch takes its own place again, and no batch reads the table.
    Sightings are numbered by batch, then by ``at``; equal ones by their content.
    """

    def run(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("url").orderBy(at, F.to_json(F.struct(*batch.columns)))
        seq = F.lit(number).cast("long") * (1 << 31) + F.row_number().over(order)
        batch.withColumn("seq", seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def enriched_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of a log of sightings, one a URL: a later sighting enriches the held row as ``ingest.reconciled`` states."""
    return reconciled(spark.read.parquet(path).drop("batch"))


def annotation_rows(rows: DataFrame) -> DataFrame:
    return annotations(rows.where("not malformed"))


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    repetitions, ease, days = state.get if state.exists else (0, FIRST_EASE, 0)
    last = None
    for r in pd.concat(list(parts)).sort_values(["reviewed_at", "review_id"]).itertuples():
        miss = 5 - r.grade
        before = ease
        ease = max(LEAST_EASE, ease + (0.1 - miss * (0.08 + miss * 0.02)))
        if r.grade < PASS:
            repetitions, days = 0, FIRST_DAYS
        else:
            repetitions += 1
            days = {1: FIRST_DAYS, 2: SECOND_DAYS}.get(repetitions) or max(days + 1, int(days * before + 0.5))
        last = r.reviewed_at
    state.update((repetitions, ease, days))
    yield pd.DataFrame({"card_id": [key[0]], "repetitions": [repetitions], "ease": [ease], "days": [days], "last_at": [last]})


def card_stream(reviews: DataFrame) -> DataFrame:
    """Card states as reviews (card_id, review_id, reviewed_at, grade) arrive."""
    out = "card_id long, repetitions int, ease double, days int, last_at timestamp"
    return reviews.groupBy("card_id").applyInPandasWithState(_advance, out, "repetitions int, ease double, days int", "update", GroupStateTimeout.NoTimeout)


HELD = "url string, title string, domain string, mode string, body string, tone double, climbed boolean, sightings int"


def enriched(held: DataFrame, sightings: DataFrame) -> DataFrame:
    """Held articles after more sightings (with ``seq`` from 0), each as ``ingest.reconciled`` states: the held row is the first sighting."""
    columns = ["url", "seq", "title", "domain", "mode", "body", "tone"]
    both = held.withColumn("seq", F.lit(-1).cast("long")).select(*columns).union(sightings.select(*columns))
    before = held.select("url", F.col("climbed").alias("had"), F.col("sightings").alias("seen"))
    met = reconciled(both).join(before, "url", "left")
    return met.withColumns({"climbed": F.col("climbed") | F.coalesce("had", F.lit(False)), "sightings": F.when(F.col("seen").isNull(), F.col("sightings")).otherwise(F.col("seen") + F.col("sightings") - 1)}).drop("had", "seen")


def enrich_into(path: str, at: str = "published_at", *, writer: str = "sightings", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that inserts unknown URLs and enriches held ones in place, exactly once.

    Only the buckets that hold a URL of the batch are read and written.  A batch is seen whole or not at all; one that comes again changes nothing.  Read the
    articles by ``KeyedTable(spark, path).read()``.
    """

    def run(batch: DataFrame, number: int) -> None:
        table = KeyedTable.create(batch.sparkSession, path, batch.sparkSession.createDataFrame([], HELD).schema, ["url"], buckets)
        order = Window.partitionBy("url").orderBy(at, F.to_json(F.struct(*batch.columns)))
        table.upsert(batch.withColumn("seq", (F.row_number().over(order) - 1).cast("long")), enriched, (writer, number))

    return run


class Expiry(StatefulProcessor):
    """Holds each article that may expire until its time is up or something keeps it."""

    def __init__(self, days: int) -> None:
        self.milliseconds = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long, kept boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        stored, kept = self.stored.get() if self.stored.exists() else (None, False)
        before = stored
        for part in rows:
            for r in part.itertuples():
                kept = kept or bool(r.keeps)
                at = int(r.stored_at.timestamp() * 1000)
                stored = at if stored is None else min(stored, at)
        if kept or before is None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not kept:
                self.handle.registerTimer(stored + self.milliseconds)
        self.stored.update((stored, kept))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        stored, kept = self.stored.get()
        self.stored.clear()
        if not kept:
            yield pd.DataFrame({"id": [key[0]], "stored_at": [pd.Timestamp(stored, unit="ms")]})

    def close(self) -> None:
        """Nothing is open."""


def expired_articles(sightings: DataFrame, days: int = 7, late: str = "0 seconds") -> DataFrame:
    """(id, stored_at) of the articles whose time is up, by the time at which they were stored, as a stream.

    ``sightings`` (id, stored_at, keeps): the row with which an article is stored, and later ones by which something keeps it: text, a story, a brief, another
    kind of connector.  State lasts as long as the article may expire: kept ones hold one boolean, expired ones nothing.  The clock is the watermark of ``stored_at``, so a
    stream that is replayed expires the same articles.  Needs the RocksDB state store.
    """
    marked = sightings.withWatermark("stored_at", late)
    return marked.groupBy("id").transformWithStateInPandas(Expiry(days), "id long, stored_at timestamp", "Append", "EventTime")
