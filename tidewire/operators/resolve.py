"""Entities from surface names: candidates, promotion, aliases, merges, co-occurrence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import DEFAULT, PROMOTABLE_KINDS, Config
from tidewire.functions.text import fold
from tidewire.functions.trigram import overlap, trigrams
from tidewire.operators.components import components
from tidewire.staging import joined_by_count, numbered, staged

IDENTITY = ["kind", "name", "feature_key"]

# Names of listed organisations as the corpus writes them, and their symbols.
TICKERS = {
    "amd": "AMD", "advanced micro devices": "AMD", "alphabet": "GOOGL", "alphabet inc": "GOOGL", "amazon": "AMZN", "amazon com": "AMZN", "apple": "AAPL", "apple inc": "AAPL",
    "intel": "INTC", "intel corporation": "INTC", "meta platforms": "META", "meta platforms inc": "META", "microsoft": "MSFT", "microsoft corporation": "MSFT", "nvidia": "NVDA",
    "nvidia corporation": "NVDA", "tsmc": "TSM", "taiwan semiconductor manufacturing company": "TSM", "tesla": "TSLA", "tesla inc": "TSLA", "google": "GOOGL", "youtube": "GOOGL",
    "facebook": "META", "instagram": "META", "meta": "META", "boeing": "BA", "the boeing company": "BA", "chevron": "CVX", "chevron corporation": "CVX", "disney": "DIS",
    "walt disney": "DIS", "the walt disney company": "DIS", "netflix": "NFLX", "netflix inc": "NFLX",
}


#: A component of certain pairs with no more than this many is folded by one task.
FOLD_PAIRS = 50_000
#: Rounds between two looks at the components.
MERGE_ROUNDS = 6


def feature_key(kind: Column, feature_id: Column) -> Column:
    return F.coalesce(F.when(kind == "location", feature_id), F.lit(""))


def folded(annotations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Promotable annotations (article_id, kind, surface_name, feature_id) with their identity, through one hop of aliases (kind, name, feature_key, target)."""
    rows = annotations.where(F.col("kind").isin(PROMOTABLE_KINDS)).withColumns({"name": fold(F.col("surface_name")), "feature_key": feature_key(F.col("kind"), F.col("feature_id"))}).where("name <> ''")
    if aliases is None:
        return rows
    return rows.join(aliases.select(*IDENTITY, "target"), IDENTITY, "left").withColumn("name", F.coalesce("target", "name")).drop("target")


def candidates(annotations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(kind, name, feature_key, articles, canonical_name): distinct articles, and the most frequent surface form, ties to the smaller."""
    rows = folded(annotations, aliases)
    counts = rows.groupBy(*IDENTITY).agg(F.countDistinct("article_id").cast("int").alias("articles"))
    forms = rows.groupBy(*IDENTITY, "surface_name").count().groupBy(*IDENTITY).agg(F.min_by("surface_name", F.struct((-F.col("count")).alias("n"), "surface_name")).alias("canonical_name"))
    return counts.join(forms, IDENTITY)


def entity_id() -> Column:
    return F.sha2(F.concat_ws("|", *IDENTITY), 256)


def promoted(found: DataFrame, entities: DataFrame, floor: int = DEFAULT.promotion_floor) -> DataFrame:
    """Entities after promotion: candidates at the floor or above; a held id stays, the name is refreshed."""
    held = entities.select(*IDENTITY, F.col("id").alias("held_id"))
    return found.where(F.col("articles") >= floor).join(held, IDENTITY, "left").select(F.coalesce("held_id", entity_id()).alias("id"), *IDENTITY, "canonical_name", "articles")


def demoted(entities: DataFrame, found: DataFrame, floor: int = DEFAULT.promotion_floor) -> DataFrame:
    """Held entities that no candidate at the floor supports."""
    return entities.join(found.where(F.col("articles") >= floor), IDENTITY, "left_anti")


def with_tickers(entities: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in TICKERS.items() for x in pair])
    return entities.withColumn("ticker", F.when(F.col("kind") == "organization", F.try_element_at(pairs, F.col("name"))))


#: Names of one gram that meet as many others in one task.
GRAM_ROWS = 1024


def _meeting(probe: DataFrame, keys: list[str], rows: int = GRAM_ROWS) -> DataFrame:
    """(keys, a, b): names, a < b, with equal keys; a key with more than ``rows`` names is cut into parts, and each two parts meet under a key of their own."""
    sized = probe.join(probe.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("parts")).where("parts > 1"), keys, "left")
    parts = F.coalesce("parts", F.lit(1))
    cut = sized.withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).withColumn("parts", parts)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left, right = cut.select(*keys, F.col("part").alias("x"), every.alias("y"), F.col("name").alias("a")), cut.select(*keys, every.alias("x"), F.col("part").alias("y"), F.col("name").alias("b"))
    return left.join(right, [*keys, "x", "y"]).where("a < b").select(*keys, "a", "b")


def merge_candidates(entities: DataFrame, refusals: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(kind, feature_key, survivor, merged, similarity): pairs of one kind and key at the review threshold or above.

    More articles survive, ties to the smaller name.  Only pairs that share a trigram can reach a positive threshold, so names meet
    through their trigrams: by the rarest ones, as many as a pair at the threshold must share one of.
    """
    names = entities.select("kind", "feature_key", "name", "articles", trigrams(F.col("name")).alias("grams"))
    each = names.select("kind", "feature_key", "name", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    often = each.groupBy("kind", "feature_key", "gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind", "feature_key", "name").orderBy("n", "gram"))
    # a pair at similarity t shares at least t * size trigrams, so one of the size - ceil(t * size) + 1 rarest of each
    probe = each.join(often, ["kind", "feature_key", "gram"]).withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(cfg.review_merge * F.col("size")) + 1)
    met = _meeting(probe, ["kind", "feature_key", "gram"]).select("kind", "feature_key", "a", "b").distinct()
    side = lambda p: names.select("kind", "feature_key", F.col("name").alias(p), F.col("articles").alias(f"{p}_articles"), F.col("grams").alias(f"{p}_grams"))
    scored = met.join(side("a"), ["kind", "feature_key", "a"]).join(side("b"), ["kind", "feature_key", "b"]).withColumn("similarity", overlap(F.col("a_grams"), F.col("b_grams")).cast("float"))
    first = (F.col("a_articles") > F.col("b_articles")) | ((F.col("a_articles") == F.col("b_articles")) & (F.col("a") < F.col("b")))
    pairs = scored.where(F.col("similarity") >= F.lit(cfg.review_merge).cast("float")).select("kind", "feature_key", F.when(first, F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("merged"), "similarity")
    return pairs if refusals is None else not_refused(pairs, refusals)


def resolved_refusals(refusals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Refused pairs (kind, feature_key, name_a, name_b) seen through aliases, in order again; pairs that became one name are gone."""
    out = refusals
    for side in ("name_a", "name_b"):
        hop = aliases.select("kind", "feature_key", F.col("name").alias(side), F.col("target").alias("t"))
        out = out.join(hop, ["kind", "feature_key", side], "left").withColumn(side, F.coalesce("t", side)).drop("t")
    return out.select("kind", "feature_key", F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).where("name_a <> name_b").distinct()


def not_refused(pairs: DataFrame, refusals: DataFrame) -> DataFrame:
    keyed = pairs.withColumns({"name_a": F.least("survivor", "merged"), "name_b": F.greatest("survivor", "merged")})
    return keyed.join(refusals, ["kind", "feature_key", "name_a", "name_b"], "left_anti").select(*pairs.columns)


def auto_merges(pairs: DataFrame, cfg: Config = DEFAULT, *, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """(kind, feature_key, name, target): aliases from merging pairs at the automatic threshold, most similar first.

    A pair is skipped when either name is gone; names that pointed at a merged one point at its survivor, so aliases stay one hop.
    A merge only looks at pairs that share a name.  So each connected component of the pairs with ``fold_pairs`` pairs or fewer is folded by itself, and the larger ones are
    worked off in rounds: a pair that comes before all others that would take one of its names away is merged at once, with all such
    pairs together, and the pairs behind it that hold the merged name are gone.  The first pair that is left always acts, so the rounds end.
    """
    place = F.struct((-F.col("similarity")).alias("s"), F.col("survivor").alias("a"), F.col("merged").alias("b"))
    end = lambda name: F.struct("kind", "feature_key", F.col(name).alias("name"))
    sure = pairs.where(F.col("similarity") >= F.lit(cfg.auto_merge).cast("float")).select(end("survivor").alias("a"), end("merged").alias("b"), place.alias("place"))
    left, found = staged(sure, "sure"), []
    while True:
        label = staged(components(left), "labels")
        each = left.join(label, left.a == label.id).drop("id")
        sized = staged(label.join(each.groupBy("component").agg(F.count("*").alias("pairs")), "component"), "sized")
        found.append(staged(_merged_whole(each.join(sized.where(F.col("pairs") <= fold_pairs).select("component").distinct(), "component")), "whole"))
        large = sized.where(F.col("pairs") > fold_pairs).select("id")
        if not large.take(1):
            break
        left = staged(left.join(large, left.a == large.id, "left_semi"), "sure")
        for _ in range(MERGE_ROUNDS):
            new, left = _merge_round(left)
            found.append(new)
            if not left.take(1):
                break
    merges = staged(reduce(DataFrame.union, found), "merges")
    return _terminal(merges).select("name.kind", "name.feature_key", "name.name", F.col("target.name").alias("target"))


def _merged_whole(pairs: DataFrame) -> DataFrame:
    """(name, target, place): the merges of whole components, each with the survivor of its own pair."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        keep = []
        for i in sorted(range(len(part)), key=lambda i: (part.s.iloc[i], part.survivor.iloc[i], part.merged.iloc[i])):
            survivor, merged = part.survivor.iloc[i], part.merged.iloc[i]
            if survivor not in gone and merged not in gone:
                gone.add(merged)
                keep.append(i)
        return part.iloc[keep][["kind", "feature_key", "survivor", "merged", "s"]]

    flat = pairs.select("component", "a.kind", "a.feature_key", F.col("a.name").alias("survivor"), F.col("b.name").alias("merged"), F.col("place.s").alias("s"))
    done = flat.groupBy("component").applyInPandas(fold, "kind string, feature_key string, survivor string, merged string, s float")
    end = lambda name: F.struct("kind", "feature_key", F.col(name).alias("name"))
    return done.select(end("merged").alias("name"), end("survivor").alias("target"))


def _merge_round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merges (name, target) of the pairs that nothing before them can stop, and the pairs that are left."""
    count = left.count()
    ends = left.select(F.col("a").alias("v"), F.lit(None).cast(left.schema["place"].dataType).alias("place"), F.lit(1).alias("own"), F.lit(0).alias("lost"))
    ends = ends.union(left.select(F.col("b").alias("v"), "place", F.lit(0), F.lit(1)))
    names = staged(ends.groupBy("v").agg(F.min("place").alias("first"), F.sum("own").alias("own"), F.sum("lost").alias("lost")), "names")
    beside = lambda rows, end, column, into, n: joined_by_count(rows, names.select(F.col("v").alias(end), F.col(column).alias(into), F.col(n).alias("n")).where("n > 0"), [end], count).drop("n")
    seen = beside(beside(left, "a", "first", "a_first", "own"), "b", "first", "b_first", "lost")
    new = staged(seen.where((F.col("place") == F.col("b_first")) & F.coalesce(F.col("place") < F.col("a_first"), F.lit(True))).select(F.col("b").alias("name"), F.col("a").alias("target"), "place"), "merged")
    died = staged(names.join(new.select(F.col("name").alias("v"), F.col("place").alias("died")), "v", "left"), "names")
    beside = lambda rows, end, into, n: joined_by_count(rows, died.select(F.col("v").alias(end), F.col("died").alias(into), F.col(n).alias("n")).where("n > 0"), [end], count).drop("n")
    marked = beside(beside(left, "a", "a_died", "own"), "b", "b_died", "lost")
    open_pairs = marked.where(F.col("b_died").isNull() & (F.col("a_died").isNull() | (F.col("place") < F.col("a_died"))) | (F.col("place") < F.col("b_died")) & F.coalesce(F.col("place") < F.col("a_died"), F.lit(True)))
    return new.select("name", "target"), staged(open_pairs.select("a", "b", "place"), "sure")


def _terminal(merges: DataFrame) -> DataFrame:
    """``merges`` (name, target) with targets that are not merged themselves: each step follows the targets of all targets, so chains halve."""
    while True:
        count = merges.count()
        often = merges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n"))
        hops = staged(merges.join(often, "name").select(F.col("name").alias("target"), F.col("target").alias("next"), "n"), "hops")
        if not hops.take(1):
            return merges
        moved = joined_by_count(merges, hops, ["target"], count).select("name", F.col("next").alias("target"))
        merges = staged(merges.join(hops.select("target"), "target", "left_anti").select("name", "target").union(moved), "merges")


def extended_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with new ones added and old targets that are merged now moved on."""
    hop = new.select("kind", "feature_key", F.col("name").alias("target"), F.col("target").alias("next"))
    moved = aliases.join(hop, ["kind", "feature_key", "target"], "left").select("kind", "name", "feature_key", F.coalesce("next", "target").alias("target"))
    return moved.unionByName(new.select("kind", "name", "feature_key", "target"))


def proposals(pairs: DataFrame, held: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Open proposals below the automatic threshold; a pair's id stays, pairs that are no longer found are gone."""
    keys = ["kind", "feature_key", "survivor", "merged"]
    open_pairs = pairs.where(F.col("similarity") < F.lit(cfg.auto_merge).cast("float"))
    return open_pairs.join(held.select(*keys, F.col("id").alias("held_id")), keys, "left").withColumn("id", F.coalesce("held_id", F.sha2(F.concat_ws("|", *keys), 256))).drop("held_id")


def decide_proposals(open_pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new aliases, new refusals, unknown decisions) from decisions (id, accept)."""
    met = open_pairs.join(decisions, "id")
    merged = met.where("accept").select("kind", F.col("merged").alias("name"), "feature_key", F.col("survivor").alias("target"))
    refused = met.where("not accept").select("kind", "feature_key", F.least("survivor", "merged").alias("name_a"), F.greatest("survivor", "merged").alias("name_b"))
    return merged, refused, decisions.join(open_pairs.select("id"), "id", "left_anti")


def mentions(annotations: DataFrame, entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct (article_id, entity_id)."""
    return folded(annotations, aliases).join(entities.select(*IDENTITY, F.col("id").alias("entity_id")), IDENTITY).select("article_id", "entity_id").distinct()


#: Entities of one article whose pairs with as many others are formed in one task.
PAIR_ROWS = 1024


def cited_pairs(mentioned: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """(article_id, a, b): pairs of entities, a < b, in one article: a row a citation, as the graph is.

    Where some article has more than ``rows`` entities, each article is cut into parts of about so many; each two parts meet under a key of their own.
    """
    counts = mentioned.groupBy("article_id").agg(F.count("*").alias("n"))
    a, b = mentioned.select("article_id", F.col("entity_id").alias("a")), mentioned.select("article_id", F.col("entity_id").alias("b"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= rows:
        return a.join(b, "article_id").where("a < b").select("article_id", "a", "b")
    parts = counts.select("article_id", F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("parts"))
    cut = mentioned.join(parts, "article_id").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = cut.select("article_id", F.col("part").alias("x"), each.alias("y"), F.col("entity_id").alias("a"))
    b = cut.select("article_id", each.alias("x"), F.col("part").alias("y"), F.col("entity_id").alias("b"))
    return a.join(b, ["article_id", "x", "y"]).where("a < b").select("article_id", "a", "b")


#: Numbers of names that lie in one list of an article.
LIST_NAMES = 1024


def listed(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, lists): candidates (n, id, kind, name, feature_key, articles, canonical_name) numbered in the order of their ids, and (article_id, part, names), the
    numbers that each article holds, in lists of ``LIST_NAMES`` at most.

    Annotations are joined and read once.  Each distinct surface form is folded once, and its number, 8 bytes, is all that is shuffled by article; counts and pairs come from the lists.
    """
    form = ["kind", "feature_key", "surface_name"]
    rows = staged(annotations.where(F.col("kind").isin(PROMOTABLE_KINDS)).select("article_id", "kind", feature_key(F.col("kind"), F.col("feature_id")).alias("feature_key"), "surface_name"), "annotated")
    forms = staged(rows.groupBy(*form).agg(F.count("*").alias("c")).withColumn("name", fold(F.col("surface_name"))).where("name <> ''"), "forms")
    best = forms.groupBy(*IDENTITY).agg(F.min_by("surface_name", F.struct((-F.col("c")).alias("c"), "surface_name")).alias("canonical_name"), F.max("c").alias("__most"))
    ids = staged(numbered(best.withColumn("id", entity_id()).drop("__most"), [F.col("id")], "n"), "ids")
    known = forms.join(ids.select(*IDENTITY, F.col("n").alias("number")), IDENTITY).select(*form, "c", "number")
    met = joined_by_count(rows, known, form, forms.agg(F.sum("c")).first()[0] or 0, n="c").select("article_id", "number")
    lists = staged(met.groupBy("article_id", F.floor(F.col("number") / LIST_NAMES).alias("part")).agg(F.array_sort(F.collect_set("number")).alias("names")), "lists")
    counts = lists.select(F.explode("names").alias("n")).groupBy("n").agg(F.count("*").cast("int").alias("articles"))
    return staged(ids.join(counts, "n").select("n", "id", *IDENTITY, "articles", "canonical_name"), "names"), lists


def cited_in(lists: DataFrame) -> DataFrame:
    """(article_id, a, b): pairs of numbers, a < b, in one article; formed row by row where each article is one list."""
    if lists.where("part > 0").take(1):
        return cited_pairs(lists.select("article_id", F.explode("names").alias("entity_id")))
    return lists.select("article_id", "names", F.posexplode("names").alias("at", "a")).select("article_id", "a", F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("b"))


def weights_in(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, weight) of the pairs of ``entities`` (n), staged; the citations themselves are not."""
    held = entities.select("n")
    pairs = staged(weighted_pairs(cited_in(lists)), "weights")
    return pairs.join(held.withColumnRenamed("n", "a"), "a", "left_semi").join(held.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b", "weight")


def edges_in(lists: DataFrame, bounded: DataFrame) -> DataFrame:
    """(a, b, article_id): the citations of the bounded pairs, by numbers."""
    return cited_in(lists).join(bounded.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "article_id")


def numbered_graph(mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity_id, n), (article_id, a, b)): entities numbered in the order of their ids, and the cited pairs by these numbers, each formed once.

    A number is 8 bytes where an id is 64 characters, and keeps its order, so ranks and ties stay the same.
    """
    ids = numbered(mentioned.select("entity_id").distinct(), [F.col("entity_id")], "n")
    short = staged(mentioned.join(ids, "entity_id").select("article_id", F.col("n").alias("entity_id")), "mentioned")
    return ids, staged(cited_pairs(short), "cited")


def named_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs by number with their ids again."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(ids.select(F.col("n").alias(end), F.col("entity_id").alias(f"{end}_id")), end).drop(end).withColumnRenamed(f"{end}_id", end)
    return out.select(*pairs.columns)


def weighted_pairs(cited: DataFrame) -> DataFrame:
    return cited.groupBy("a", "b").agg(F.count("*").alias("weight"))


def bounded_pairs(pairs: DataFrame, k: int, focus: Column | None = None) -> DataFrame:
    """(a, b, weight) of the pairs that are among the first ``k`` of either end, by weight, then the other's id; pairs with ``focus`` always stay."""
    ends = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "weight").union(pairs.select("b", "a", "weight"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("weight"), "other"))
    keep = F.col("rank") <= k
    if focus is not None:
        keep = keep | (F.col("own") == focus)
    kept = ends.withColumn("rank", rank).where(keep)
    return kept.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "weight").distinct()


def bounded_edges(mentioned: DataFrame, k: int = DEFAULT.edges_per_entity) -> DataFrame:
    """(a, b, weight) of the bounded pairs."""
    ids, cited = numbered_graph(mentioned)
    return named_pairs(bounded_pairs(weighted_pairs(cited), k), ids)


def edges(mentioned: DataFrame, k: int = DEFAULT.edges_per_entity) -> DataFrame:
    """(a, b, article_id): the citations of the bounded pairs."""
    ids, cited = numbered_graph(mentioned)
    kept = cited.join(bounded_pairs(weighted_pairs(cited), k).select("a", "b"), ["a", "b"], "left_semi")
    return named_pairs(kept, ids)


def ledger(annotations: DataFrame, found: DataFrame, gone: DataFrame, new_aliases: DataFrame, open_pairs: DataFrame, edge_rows: DataFrame, floor: int = DEFAULT.promotion_floor) -> DataFrame:
    """One row of counts of a pass; promoted + below_floor = considered."""
    parts = [
        annotations.agg(F.count("*").alias("read")),
        found.agg(F.count("*").alias("considered"), F.count_if(F.col("articles") >= floor).alias("promoted"), F.count_if(F.col("articles") < floor).alias("below_floor")),
        gone.agg(F.count("*").alias("demoted")), new_aliases.agg(F.count("*").alias("merged")), open_pairs.agg(F.count("*").alias("proposed")), edge_rows.select("a", "b").distinct().agg(F.count("*").alias("edges")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out
