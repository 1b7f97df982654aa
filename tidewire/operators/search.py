"""Hybrid search: weighted terms, vectors, reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import ACCEPTED, DEFAULT, Config
from tidewire.functions.stem import stemmed
from tidewire.functions.vectors import cosine_distance
from tidewire.staging import joined_by_count, numbered, staged

TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
# Words that the English index leaves out.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now
""".split()


def tokens(text: Column) -> Column:
    """The lower-case words of a text, without stop words and not yet stemmed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


#: Distinct words that one task stems.
STEM_ROWS = 50_000


def postings(rows: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """(term, key, weight): frequencies of stems weighted by field; a null body leaves the title's terms.

    Rows of one key are together once, so its words are counted without a shuffle of words.  A stem is worked out once for each distinct word of all rows and
    meets the counts by :func:`joined_by_count`.  Occurrences are whole numbers until the end, so a weight does not depend on the order of rows.
    """
    fields = F.concat(F.transform(tokens(F.col(title)), lambda t: F.struct(t.alias("t"), F.lit(True).alias("head"))), F.transform(tokens(F.col(body)), lambda t: F.struct(t.alias("t"), F.lit(False).alias("head"))))
    each = rows.select(key, title, body).repartition(key).select(F.col(key), F.explode(fields).alias("p"))
    words = staged(each.groupBy(key, F.col("p.t").alias("word")).agg(F.count_if("p.head").alias("heads"), F.count_if(~F.col("p.head")).alias("bodies")), "words")
    known = staged(words.groupBy("word").agg(F.count("*").alias("n")), "known")
    size, total = known.agg(F.count("*"), F.sum("n")).first()
    stems = staged(stemmed(known.repartition(max(1, -(-size // STEM_ROWS))), "word", "term"), "stems")
    counted = joined_by_count(words, stems, ["word"], total or 0).groupBy("term", key).agg(F.sum("heads").alias("heads"), F.sum("bodies").alias("bodies"))
    return counted.select("term", key, (F.col("heads") * TITLE_WEIGHT + F.col("bodies") * BODY_WEIGHT).alias("weight"))


def analyzed(spark: SparkSession, text: str) -> list[str]:
    """The terms of a query: its distinct stems, without stop words."""
    words = spark.createDataFrame([(text,)], "text string").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return sorted({r["term"] for r in stemmed(words, "word", "term").collect()})


def matches(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, rank): rows that hold all terms, with their summed weights at six decimals, as sums in another order differ in the last bits."""
    hit = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.countDistinct("term").alias("n"), F.round(F.sum("weight"), 6).alias("rank"))
    return hit.where(F.col("n") == len(set(terms))).select(key, "rank")


def lexical(articles: DataFrame, article_index: DataFrame, story_index: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """(id, lexical_rank) of accepted articles that match themselves or through their story; article's and story's rank add up.

    The matches come first and meet the articles; articles without one are not carried along.  Scores are ranked at six decimals, as the same weights added in
    another order differ in the last bits and are ties.
    """
    known = articles.where(F.col("status") == ACCEPTED).select("id", "story_id")
    own = known.select("id").join(matches(article_index, "id", terms), "id")
    through = known.join(matches(story_index, "story_id", terms), "story_id").select("id", "rank")
    met = own.union(through).groupBy("id").agg(F.sum("rank").alias("score"))
    return ranked(met, [F.desc(F.round("score", 6)), F.col("id")], "lexical_rank", limit)


def ranked(rows: DataFrame, order: list[Column], into: str, limit: int | None = None) -> DataFrame:
    """(id, position) in the given order.

    With a limit the first rows are taken before the window, which sees few.  Without one the rows are numbered in
    ranges, so no task sees them all.
    """
    if limit is not None:
        return rows.orderBy(*order).limit(limit).withColumn(into, F.row_number().over(Window.orderBy(*order))).select("id", into)
    return numbered(rows, order, "__place").select("id", (F.col("__place") + 1).cast("int").alias(into))


def semantic(articles: DataFrame, vector: list[float] | None, cfg: Config = DEFAULT) -> DataFrame:
    """(id, semantic_rank): the pool of nearest accepted articles, then those within the distance; no vector, no rows."""
    spark = articles.sparkSession
    if vector is None:
        return spark.createDataFrame([], "id long, semantic_rank int")
    distance = cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
    near = articles.where((F.col("status") == ACCEPTED) & F.col("embedding").isNotNull()).select("id", distance.alias("distance")).where("distance is not null")
    pool = near.orderBy("distance", "id").limit(cfg.pool).where(F.col("distance") <= cfg.max_distance)
    return pool.withColumn("semantic_rank", F.row_number().over(Window.orderBy("distance", "id"))).select("id", "semantic_rank")


def fused(lex: DataFrame, sem: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """(id, score): reciprocal rank fusion; a side that misses an article adds nothing."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return lex.join(sem, "id", "full_outer").select("id", (part("lexical_rank") + part("semantic_rank")).alias("score"))


def filtered(hits: DataFrame, articles: DataFrame, stories: DataFrame, category: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    out = hits.join(articles.select("id", "story_id", "published_at"), "id").join(stories.select("story_id", "category"), "story_id")
    if category is not None:
        out = out.where(F.col("category") == category)
    if start is not None:
        out = out.where(F.col("published_at") >= start)
    if end is not None:
        out = out.where(F.col("published_at") <= end)
    return out


def page(hits: DataFrame, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page with their position, total): the total is its own row, so a page past the end still has it."""
    order = [F.desc("score"), F.col("id")]
    cut = hits.orderBy(*order).offset((number - 1) * size).limit(size)
    return cut.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + (number - 1) * size), hits.agg(F.count("*").alias("total"))


def hydrated(hits: DataFrame, articles: DataFrame, stories: DataFrame) -> DataFrame:
    """Hits with article and story, in hit order; hits without a story are left out."""
    return hits.select("pos", "id", "score").join(articles.select("id", "title", "story_id", "published_at"), "id").join(stories.select("story_id", F.col("title").alias("story_title")), "story_id").orderBy("pos")


def query_vector(text: str, embed) -> list[float] | None:
    """The query's vector, or None where the provider fails: search then goes on by words alone."""
    try:
        return list(embed([text])[0])
    except Exception:  # noqa: BLE001 - any provider error degrades the search
        return None


def hybrid(articles: DataFrame, stories: DataFrame, article_index: DataFrame, story_index: DataFrame, terms: list[str], vector: list[float] | None, cfg: Config = DEFAULT) -> DataFrame:
    """(id, score, story_id, published_at, category) of all hits."""
    return filtered(fused(lexical(articles, article_index, story_index, terms), semantic(articles, vector, cfg), cfg.rrf_k), articles, stories)
