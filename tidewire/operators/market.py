"""Indicators over daily closes (ticker, date, adj_close), quotes and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import ACCEPTED, DEFAULT
from tidewire.operators.resolve import IDENTITY, folded


# Fixed value: letters and digits with an optional class or exchange suffix.
TICKER = r"^[A-Z][A-Z0-9]{0,6}(?:[.\-][A-Z]{1,3})?$"


def _sound(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sma(closes: DataFrame, n: int) -> DataFrame:
    """(ticker, sma): mean of the last n closes; null where the series is short or holds a value that is not finite."""
    if n < 1:
        return closes.select("ticker", F.lit(None).cast("double").alias("sma")).distinct()
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = closes.withColumn("rank", rank).groupBy("ticker").agg(F.count("*").alias("n"), F.every(_sound(F.col("adj_close"))).alias("sound"), F.avg(F.when(F.col("rank") <= n, F.col("adj_close"))).alias("mean"))
    return rows.select("ticker", F.when(F.col("sound") & (F.col("n") >= n), F.col("mean")).alias("sma"))


def rsi(closes: DataFrame, n: int = DEFAULT.rsi_period) -> DataFrame:
    """(ticker, rsi): Wilder's relative strength; the first n changes seed the means.  A flat series has 50, one without losses 100."""
    series = closes.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "adj_close"))), lambda x: x["adj_close"]).alias("c"))
    changes = F.zip_with(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a - b)
    gain, loss = (lambda x: F.greatest(x, F.lit(0.0))), (lambda x: F.greatest(-x, F.lit(0.0)))
    seed = lambda f: F.aggregate(F.slice("d", 1, n), F.lit(0.0), lambda s, x: s + f(x)) / n
    step = lambda acc, x: F.struct(((acc["g"] * (n - 1) + gain(x)) / n).alias("g"), ((acc["l"] * (n - 1) + loss(x)) / n).alias("l"))
    done = F.aggregate(F.slice("d", F.lit(n + 1), F.greatest(F.size("d") - n, F.lit(0))), F.struct(seed(gain).alias("g"), seed(loss).alias("l")), step)
    out = series.withColumn("d", changes).withColumn("m", F.when((F.size("d") >= n) & ~F.exists("c", lambda x: ~_sound(x)), done))
    value = F.when((F.col("m.g") == 0) & (F.col("m.l") == 0), 50.0).when(F.col("m.l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("m.g"), F.col("m.l"))))
    return out.select("ticker", F.when(F.col("m").isNotNull(), value).alias("rsi"))


def volatility(closes: DataFrame, days: int = DEFAULT.trading_days) -> DataFrame:
    """(ticker, volatility): sample deviation of log returns over a year, in percent; three closes at least, all above zero."""
    before = F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))
    good = _sound(F.col("adj_close")) & (F.col("adj_close") > 0)
    rows = closes.withColumn("before", before).withColumn("r", F.when(good & (F.col("before") > 0), F.log(F.try_divide("adj_close", "before"))))
    out = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.every(good).alias("good"), F.stddev_samp("r").alias("s"))
    return out.select("ticker", F.when(F.col("good") & (F.col("n") >= 3), F.col("s") * F.sqrt(F.lit(float(days))) * 100).alias("volatility"))


def normal_ticker(raw: Column) -> Column:
    clean = F.upper(F.trim(raw))
    return F.when(clean.rlike(TICKER), clean)


def quotes(closes: DataFrame) -> DataFrame:
    """(ticker, price, change, change_percent) from the last two closes; the percentage needs a previous price above zero."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = closes.withColumn("previous", F.lag("adj_close").over(w)).groupBy("ticker").agg(F.max_by(F.struct("adj_close", "previous"), "date").alias("q"))
    change = F.col("q.adj_close") - F.col("q.previous")
    return rows.select("ticker", F.col("q.adj_close").alias("price"), change.alias("change"), F.when(F.col("q.previous") > 0, change / F.col("q.previous") * 100).alias("change_percent"))


def story_entities(articles: DataFrame, annotations: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """(story_id, entity_id, name, ticker, total): listed organisations of accepted articles, by name, the first of each story with their total."""
    orgs = folded(annotations.where("kind = 'organization'"), aliases).select("article_id", *IDENTITY)
    listed = entities.where("ticker is not null").select(*IDENTITY, F.col("id").alias("entity_id"), "canonical_name", "ticker")
    member = articles.where(F.col("status") == ACCEPTED).select(F.col("id").alias("article_id"), "story_id")
    found = orgs.join(member, "article_id").join(listed, IDENTITY).select("story_id", "entity_id", "canonical_name", "ticker").distinct()
    w = Window.partitionBy("story_id")
    rows = found.withColumns({"rank": F.row_number().over(w.orderBy("canonical_name", "entity_id")), "total": F.count("*").over(w).cast("int")})
    return rows.where(F.col("rank") <= limit).drop("rank")


def panel_status(panels: DataFrame, group: str = "story_id") -> DataFrame:
    """(group, status) of panels with ``state``: ready if any is, else unavailable if any is, else empty."""
    return panels.groupBy(group).agg(F.when(F.some(F.col("state") == "ready"), "ready").when(F.some(F.col("state") == "unavailable"), "unavailable").otherwise("empty").alias("status"))


def market_read_input(articles: DataFrame, indicators: DataFrame, limit: int = 8, chars: int = 900) -> DataFrame:
    """(story_id, blocks, indicators): excerpts of the first accepted articles by date, beside the story's panel."""
    rank = F.row_number().over(Window.partitionBy("story_id").orderBy("published_at", "id"))
    rows = articles.where(F.col("status") == ACCEPTED).withColumn("rank", rank).where(F.col("rank") <= limit)
    blocks = rows.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("body", 1, chars).alias("t")))), lambda x: x["t"]).alias("blocks"))
    return blocks.join(indicators, "story_id", "left")


def read_through(asked: DataFrame, held: DataFrame, fetched: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Answers (key, asked_at, state, value) to requests (key, asked_at), and the cache (key, value, stored_at) after them.

    An entry serves for ``seconds`` from when it was stored, a null value too.  Otherwise the fetched row (key, value, ok) is the answer and
    is stored; an outage (not ok, or no row) answers null and is never stored.  States: ``hit``, ``miss``, ``expired``, ``outage``.
    """
    met = asked.join(held.select("key", F.col("value").alias("old"), "stored_at"), "key", "left").join(fetched.select("key", F.col("value").alias("new"), "ok"), "key", "left")
    fresh = F.coalesce(F.unix_timestamp("asked_at") - F.unix_timestamp("stored_at") < seconds, F.lit(False))
    reached = F.coalesce("ok", F.lit(False))
    state = F.when(fresh, "hit").when(~reached, "outage").when(F.col("stored_at").isNotNull(), "expired").otherwise("miss")
    judged = met.withColumn("state", state)
    answers = judged.select("key", "asked_at", "state", F.when(fresh, F.col("old")).when(reached, F.col("new")).alias("value"))
    stored = judged.where("state in ('miss', 'expired')").groupBy("key").agg(F.max("new").alias("value"), F.min("asked_at").alias("stored_at"))
    return answers, held.join(stored.select("key"), "key", "left_anti").select("key", "value", "stored_at").unionByName(stored)
