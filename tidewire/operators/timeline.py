"""Timelines: axis, zero-filled volume, lanes.  Times are epoch seconds (column ``at``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import DEFAULT

HOUR, DAY, WEEK = 3600, 86400, 7 * 86400


def event_stream(freezes: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence freezes (story_id, frozen_at) and completed runs (story_id, lens, completed_at) as one stream of events."""
    a = freezes.select("story_id", F.lit("evidence_frozen").alias("event"), F.col("frozen_at").alias("at"))
    b = runs.where("status = 'completed'").select("story_id", F.lit("analysis_completed").alias("event"), F.col("completed_at").alias("at"), "lens")
    return a.unionByName(b, allowMissingColumns=True)


def axis(points: DataFrame, events: DataFrame, groups: list[str], most: int = DEFAULT.timeline_buckets) -> DataFrame:
    """(groups, from_at, to_at, granularity, size, origin, buckets, points) over points and events of each group.

    The finest of hour, day and week that needs at most ``most`` buckets, else week.  Days and hours are aligned to
    themselves, weeks start on the first day.
    """
    both = points.select(*groups, "at", F.lit(1).alias("is_point")).union(events.select(*groups, "at", F.lit(0)))
    span = both.groupBy(*groups).agg(F.min("at").alias("from_at"), F.max("at").alias("to_at"), F.sum("is_point").cast("int").alias("points"))

    def count(size: int) -> Column:
        anchor = min(size, DAY)
        origin = F.floor(F.col("from_at") / anchor) * anchor
        return F.floor((F.col("to_at") - origin) / size) + 1

    name = F.when(count(HOUR) <= most, "hour").when(count(DAY) <= most, "day").otherwise("week")
    size = F.when(count(HOUR) <= most, HOUR).when(count(DAY) <= most, DAY).otherwise(WEEK)
    anchor = F.least(F.col("size"), F.lit(DAY))
    out = span.withColumns({"granularity": name, "size": size}).withColumn("origin", (F.floor(F.col("from_at") / anchor) * anchor).cast("long"))
    return out.withColumn("buckets", (F.floor((F.col("to_at") - F.col("origin")) / F.col("size")) + 1).cast("int"))


def volume(points: DataFrame, axes: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, bucket, period_start, n): every bucket, empty ones with 0; no bucket where a group has no points."""
    slots = axes.where("points > 0").select(*groups, "origin", "size", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    placed = points.join(axes.select(*groups, "origin", "size"), groups).withColumn("bucket", F.floor((F.col("at") - F.col("origin")) / F.col("size")).cast("int"))
    counts = placed.groupBy(*groups, "bucket").agg(F.count("*").cast("int").alias("n"))
    return slots.join(counts, [*groups, "bucket"], "left").select(*groups, "bucket", (F.col("origin") + F.col("bucket") * F.col("size")).alias("period_start"), F.coalesce("n", F.lit(0)).alias("n"))


def lanes(points: DataFrame, axis_row: DataFrame) -> DataFrame:
    """(story_id, position, volume): a dense array for each story on one shared axis, stories in the order of their first article."""
    placed = points.where("story_id is not null").join(F.broadcast(axis_row.select("origin", "size", "buckets"))).withColumn("bucket", F.floor((F.col("at") - F.col("origin")) / F.col("size")).cast("int"))
    counts = placed.groupBy("story_id", "bucket", "buckets").agg(F.count("*").cast("int").alias("n"), F.min(F.struct("at", "id")).alias("first"))
    lane = counts.groupBy("story_id", "buckets").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.min("first").alias("first"))
    dense = F.transform(F.sequence(F.lit(0), F.col("buckets") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return lane.select("story_id", "first", dense.alias("volume"))
