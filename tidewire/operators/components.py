"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum, with partial aggregation, and a join in which vertices with very many links are kept
apart.  Each round is written to the shared folder, which cuts the lineage.  The number of rounds grows with the
logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.staging import hot_limit, joined_by_count, staged


def _joined(rows: DataFrame, least: DataFrame, largest: int, count: int) -> DataFrame:
    """``rows`` with ``least`` by u; vertices with very many rows are kept apart where there are any."""
    return joined_by_count(rows, least, ["u"], count) if largest > hot_limit(count) else rows.join(least, "u")


def _large_star(edges: DataFrame, largest: int, count: int) -> DataFrame:
    """Links each larger neighbour of u to the least vertex around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    least = least.where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
    return _joined(both.where("v > u"), least, largest, count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, largest: int, count: int) -> DataFrame:
    """Links u and its smaller neighbours to the least of them; ``edges`` lead from the larger to the smaller vertex."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(edges, least, largest, count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """The number of edges, two digests of their set, and the most larger and smaller neighbours of a vertex.

    A large star leaves no vertex with more smaller neighbours than it had.
    """
    down = F.col("v") < F.col("u")
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    marks = F.when(down, F.xxhash64("u", "v")).cast("decimal(20,0)"), F.when(down, F.xxhash64(F.lit(1), "u", "v"))
    around = both.groupBy("u").agg(F.count_if(down).alias("smaller"), F.count_if(~down).alias("larger"), F.sum(marks[0]).alias("a"), F.bit_xor(marks[1]).alias("b"))
    found = around.agg(F.sum("smaller"), F.sum("a"), F.bit_xor("b"), F.max("larger"), F.max("smaller")).first()
    return tuple(found)


def contracted(links: DataFrame, a: str = "a", b: str = "b", *, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, with the same components as ``links``: after so many rounds, or when each vertex hangs on the least one of its component.

    Self-links, repeated links and links with a null end are ignored.  Vertices may be of any type that has an order.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, seen, done = staged(ends.distinct(), "edges"), None, 0
    state = _state(edges)
    while state != seen and state[0] and (rounds is None or done < rounds):
        seen, (count, _, _, larger, smaller), done = state, state, done + 1
        edges = staged(_small_star(_large_star(edges, larger, count), smaller, count).distinct(), "edges", 2 * count)
        if rounds is None or done < rounds:
            state = _state(edges)
    return edges


def labels(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of ``contracted`` edges: vertices of one label are connected, and after enough rounds all connected ones have one."""
    low = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).distinct().join(low.select("id"), "id", "left_anti")
    return low.unionByName(roots.withColumn("component", F.col("id")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has a link to another; ``component`` is the least vertex of its component.

    Self-links, repeated links and links with a null end are ignored; no links give an empty result.
    """
    edges = contracted(links, a, b)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
