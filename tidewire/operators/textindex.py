"""A lexical index at rest: postings by term, updated window by window, read term by term.

Postings lie in a table of key buckets (:mod:`tidewire.sources.keyed`) by the hash of their term, sorted by term, the heaviest first; a query opens the
buckets of its terms and nothing else.  ``tier`` is the power of two that a weight reaches, so a top-k search can read the heavy postings of a
term first and stop as soon as no lighter one can matter.

An update adds postings under a stamp and reads none.  A row that comes again under a later stamp replaces its postings: the table ``rows`` holds the stamp of each row,
``gone`` what the stamps before it were.  A window is seen by readers when ``rows`` is committed, which comes last; until then they pass over its stamp.  A window that
comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.search import analyzed, postings
from tidewire.sources.keyed import KeyedTable
from tidewire.staging import staged

WRITER = "windows"
#: Weights are counted in these units, so tiers begin at 0.
UNIT = 0.1


def tier(weight: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(weight) / UNIT, F.lit(1.0)) * (1 + 1e-12))).cast("int")


class TextIndex:
    """An index of (key, title, body) rows at a path."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, buckets: int = 64) -> None:
        self.spark, self.key = spark, key
        make = lambda name, ddl, keys: KeyedTable.create(spark, f"{path.rstrip('/')}/{name}", spark.createDataFrame([], ddl).schema, keys, buckets)
        self.postings = make("postings", f"term string, {key} {kind}, weight double, tier int, stamp long", ["term"])
        self.rows = make("rows", f"{key} {kind}, stamp long", [key])
        self.gone = make("gone", f"{key} {kind}, stamp long, since long", [key])

    def seen(self) -> int:
        """The stamp of the last window that is whole."""
        return self.rows.version().batches.get(WRITER, -1)

    def add(self, rows: DataFrame, stamp: int, title: str, body: str) -> bool:
        """Adds a window of rows; False if its stamp is known.  Stamps rise; of rows of one key in a window one counts."""
        if stamp <= self.seen():
            return False
        rows = staged(rows.select(self.key, title, body).dropDuplicates([self.key]), "window")
        new = postings(rows, self.key, title, body).withColumn("tier", tier("weight")).withColumn("stamp", F.lit(stamp).cast("long"))
        self.postings.append(new.select("term", self.key, "weight", "tier", "stamp"), (WRITER, stamp), order=["term", F.desc("weight"), self.key], spread=self.key)
        held = self.rows.version()
        buckets = [r[0] for r in rows.select(self.rows.bucket(held)).distinct().collect()]  # no more than there are buckets
        old = self.rows.read(buckets, version=held).join(rows.select(self.key), self.key, "left_semi").withColumn("since", F.lit(stamp).cast("long"))
        self.gone.append(old, (WRITER, stamp))
        latest = lambda before, now: before.join(now.select(self.key), self.key, "left_anti").unionByName(now)
        self.rows.upsert(rows.select(self.key, F.lit(stamp).cast("long").alias("stamp")), latest, (WRITER, stamp))
        return True

    def _current(self, found: DataFrame) -> DataFrame:
        """Postings of whole windows that no later one replaced."""
        last, replaced = self.seen(), self.gone.version()
        found = found.where(F.col("stamp") <= last)
        if replaced.files:  # without any the postings need no shuffle
            gone = self.gone.read(version=replaced).where(F.col("since") <= last).select(self.key, "stamp")
            found = found.join(gone, [self.key, "stamp"], "left_anti")
        return found.select("term", self.key, "weight", "tier")

    def all(self) -> DataFrame:
        """(term, key, weight, tier) of the whole index."""
        return self._current(self.postings.read())

    def of(self, terms: list[str]) -> DataFrame:
        """(term, key, weight, tier) of a few terms, from the files of their buckets."""
        return self._current(self.postings.lookup([(t,) for t in dict.fromkeys(terms)]))

    def top(self, terms: list[str], k: int) -> tuple[DataFrame, dict[str, int]]:
        """(key, rank) of the ``k`` heaviest rows that hold all terms, ties to the smaller key, and how many postings were read of how many.

        Reads the postings tier by tier, the heaviest first, until the k-th complete row weighs no less than any incomplete one still can.
        """
        terms = list(dict.fromkeys(terms))
        found = staged(self.of(terms), "found") if terms else self.of([])
        counts = dict(found.groupBy("tier").count().collect())  # a row a tier
        read, best = 0, found.where("false").select(self.key, F.lit(0.0).alias("rank"))
        for floor in sorted(counts, reverse=True):
            read += counts[floor]
            if read < k * len(terms) and floor > min(counts):
                continue  # too few for k complete rows
            cap = UNIT * 2.0**floor if floor else 0.0  # what is not read weighs less
            rows = found.where(F.col("tier") >= floor).groupBy(self.key).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("rank"))
            best = staged(rows.where(F.col("n") == len(terms)).orderBy(F.desc("rank"), self.key).limit(k).select(self.key, "rank"), "top")
            kth = best.agg(F.min("rank"), F.count("*")).first()
            open_rows = rows.where(F.col("n") < len(terms)).agg(F.max(F.col("rank") + (len(terms) - F.col("n")) * cap)).first()[0]
            if kth[1] == k and kth[0] >= max(open_rows or 0.0, len(terms) * cap):
                break
        return best.orderBy(F.desc("rank"), self.key), {"read": read, "held": sum(counts.values())}

    def search(self, text: str, k: int) -> DataFrame:
        """(key, rank) of the rows that hold all words of a text, by their stems."""
        return self.top(analyzed(self.spark, text), k)[0]
