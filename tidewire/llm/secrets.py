"""Secret scans with character Markov models, in DataFrame functions alone.

Three kinds are found by pattern: ``assign`` (a secret's name, a separator and a value), ``access`` (key ids) and ``hex`` (long
hexadecimal strings).  A fourth kind, ``random``, is what two first-order Markov models tell apart: one of random strings, one of
ordinary identifiers.  A run of key-like characters is a secret if the log-likelihood ratio of the two exceeds the prior
odds and is high enough for each character; where it is not, its parts between ``/`` and ``=`` are judged alike.  Runs without a letter
are none, and spans of this kind that touch one of the others are left out.

The models are trained from labelled samples: random strings in base 64, base 62 and hexadecimal against identifiers joined from the
words of all documents.  Words are counted first, so a character is looked at once for each distinct word; the trained table has one number for
each pair of characters of a fixed alphabet, whatever the size of the corpus.

Positions are code points, end exclusive.  A text with anything to look at is cut into segments of about ``SEGMENT_LEAST`` characters at
places that no span can cross: beside a character that occurs in none, or at spaces that stand neither before nor after a colon or an
equals sign.  Java's regular expressions give the matches of a segment and its parts between them (``split`` with the same pattern) their
places; running sums over blocks move them to the text.  So the work grows with the text, however many spans it has.

Results for odd input: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty table;
other columns are not read, or are carried by :func:`redact`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shared import text_of

# The base patterns.
NAMES = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
PIECE = rf"[A-Za-z0-9+_-]{{{LEAST},}}"
WIDTH = len(ALPHABET) + 1
SAMPLE_RANDOM = 20_000
PRIOR = math.log(1e4)
PER_CHARACTER = 1.2
REPEATED = 0.05
UNSEEN = 0.02
MASK = "[secret]"
SEGMENT_LEAST = 512
_INSIDE = r"A-Za-z0-9+/_.=:\"'-"
SEGMENT = rf"(?s)(?:.{{0,{SEGMENT_LEAST - 1}}}[^\x20])?+[{_INSIDE}]*+(?:(?:(?<=[:=])\x20++|\x20++(?=[:=]))[{_INSIDE}]++)*+[^{_INSIDE}]*+"
ANY = rf"{NAMES}|{ACCESS}|{CANDIDATE}"
RUNNING = 64
CHUNK = 4096
SPANS = "array<struct<start:int,kind:int,end:int>>"


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """``n`` reproducible random strings (token): base 64, base 62 and hexadecimal in turn."""
    seed = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    base64 = F.substring(F.base64(F.unhex(seed)), 1, 40)
    token = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.regexp_replace(base64, "[+/=]", "")).otherwise(F.substring(seed, 1, 40))
    return spark.range(n).select(token.alias("token"))


def ordinary_words(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(token, n): the distinct words of all documents outside base spans, and how often each occurs."""
    content = text_of(docs, text)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, ASSIGN, " "), ACCESS, " "), HEX, " ")
    clean = F.when(content.rlike(rf"{NAMES}|{ACCESS}|{HEX}"), bare).otherwise(content)
    words = docs.select(F.explode(F.split(clean, "[^A-Za-z0-9]+")).alias("token")).where(F.length("token").between(2, 29))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(pair, first, last, n): neighbouring characters in tokens of two characters or more that occur ``n`` times each, and whether a token begins or ends there.

    No more rows than four times the square of the alphabet, whatever the number of tokens.
    """
    each = tokens.where(F.length("token") > 1).select("token", "n", F.explode(F.sequence(F.lit(2), F.length("token"))).alias("i"))
    pair = each.select(F.substring("token", F.col("i") - 1, F.lit(2)).alias("pair"), (F.col("i") == 2).alias("first"), (F.col("i") == F.length("token")).alias("last"), "n")
    return pair.groupBy("pair", "first", "last").agg(F.sum("n").alias("n"))


def _random_transitions(rows: list) -> Counter:
    """How often one character follows another in the random strings; the empty string stands before the first."""
    out: Counter = Counter()
    for pair, first, _, n in rows:
        out[pair[0], pair[1]] += n
        if first:
            out["", pair[0]] += n
    return out


def _ordinary_transitions(rows: list) -> Counter:
    """The same in identifiers made of the words: a word as it is, and two words joined in snake, camel and upper case and with a dash and a date."""
    out, firsts, lasts = Counter(), Counter(), Counter()
    for (a, b), first, last, n in rows:
        firsts[a] += n * first
        lasts[b] += n * last
        out[a, b] += n
        out[a.lower(), b.lower()] += 4 * n  # two words each in snake case and with dashes
        out[a.upper(), b.upper()] += 2 * n
        out[a.upper() if first else a.lower(), b.lower()] += 2 * n
    total = sum(firsts.values())
    for a, n in firsts.items():
        out["", a] += n
        out["", a.lower()] += 2 * n
        out["", a.upper()] += 2 * n
        out["_", a.lower()] += n
        out["-", a.lower()] += n
        out["_", a.upper()] += n
    for b, n in lasts.items():
        out[b.lower(), "_"] += n
        out[b.lower(), "-"] += n
        out[b.upper(), "_"] += 2 * n
        out[b.lower(), "/"] += n
        for a, m in firsts.items():
            out[b.lower(), a.upper()] += n * m / total
    for tail in ("_V2", "/2024-12-31"):
        for pair in zip(tail, tail[1:], strict=False):
            out[pair] += total
    return out


def train(random: DataFrame, words: DataFrame) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each pair of characters; pair (a, b) is at a * WIDTH + b, 0 stands before the first.

    ``random`` has tokens, ``words`` tokens with their counts.  The smoothing is a share of the probability (``UNSEEN``), and a character that repeats itself is
    ordinary with a probability of ``REPEATED`` at least, so verdicts do not drift with the size of the corpus.
    """
    counts = [_ordinary_transitions(pair_counts(words).collect()), _random_transitions(pair_counts(random.withColumn("n", F.lit(1).cast("long"))).collect())]  # bounded by the alphabet
    table = []
    for before in ["", *ALPHABET]:
        totals = [sum(c[before, after] for after in ALPHABET) for c in counts]
        table.append(0.0)
        for after in ALPHABET:
            seen = ((c[before, after] + 0.5) / (total + 0.5 * len(ALPHABET)) for c, total in zip(counts, totals, strict=True))
            ordinary, chance = ((1 - UNSEEN) * p + UNSEEN / len(ALPHABET) for p in seen)
            table.append(math.log(chance / (max(ordinary, REPEATED) if before == after else ordinary)))
    return table


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once: what ``f`` gets is a variable, also inside further lambda functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token over ``ALPHABET``; a long token is looked at chunk by chunk."""
    weights = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folded into one literal by the optimiser
    codes = lambda chunk: F.transform(F.filter(F.split(chunk, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))
    step = lambda acc, c: F.struct(c.alias("before"), (acc["total"] + F.element_at(weights, acc["before"] * WIDTH + c + 1)).alias("total"))
    chunks = F.regexp_extract_all(token, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.aggregate(chunks, start, lambda acc, chunk: F.aggregate(codes(chunk), acc, step), lambda acc: acc["total"])


def _running(sizes: Column) -> Column:
    """The sum of the sizes before each: within blocks after the sum of the blocks before, so no long array is copied for each size."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(s) - 1) / RUNNING).cast("int"))), lambda b: F.slice(s, b * RUNNING + 1, F.lit(RUNNING)))

    def summed(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda s: F.aggregate(s, F.lit(0), lambda acc, x: acc + x)), F.array(F.lit(0)), grow)
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda s, at: F.slice(F.aggregate(s, F.array(at), grow), F.lit(1), F.size(s))))

    return bound(sizes, lambda s: bound(cut(s), summed))


def _spans(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column] | None, screen: str, group: int = 0) -> Column:
    """Spans (start, kind, end) of the pattern's matches; ``keep`` says of the text of ``group`` in a match whether the span stays.  ``screen``: what a text with a match holds."""

    def placed(sizes: Column, gaps: Column) -> Column:
        starts = F.zip_with(_running(F.zip_with(gaps, sizes, lambda g, n: g + n)), gaps, lambda at, g: at + g)
        return F.zip_with(starts, sizes, lambda at, n: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + n).alias("end")))

    gaps = lambda sizes: F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(sizes))
    whole = lambda found: bound(F.transform(found, F.length), lambda sizes: bound(gaps(sizes), lambda g: placed(sizes, g)))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if keep is None:
        spans = bound(matches, whole)
    else:
        judged = lambda found: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found, keep)
        spans = bound(matches, lambda found: F.transform(F.filter(F.zip_with(whole(found), judged(found), lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"]))
    return F.when(text.rlike(screen), spans).otherwise(F.array().cast(SPANS))


def _base(text: Column) -> Column:
    assign = _spans(text, 0, ASSIGN, lambda v: F.length(v) >= ASSIGN_LEAST, NAMES, 1)
    return F.array_sort(F.concat(assign, _spans(text, 1, ACCESS, None, ACCESS), _spans(text, 2, HEX, None, HEX)))


def _segments(read: DataFrame, table: list[float]) -> DataFrame:
    """Adds ``segments`` of the text, empty where there is nothing to look at, and ``base`` and ``added`` of each segment, in its own positions."""

    def secret(token: Column) -> Column:
        return token.rlike("[A-Za-z]") & (likelihood_ratio(token, table) > F.greatest(F.lit(PRIOR), PER_CHARACTER * F.length(token)))

    def judged(pattern: str) -> Column:
        return F.transform("segments", lambda s: _spans(s, 3, pattern, secret, pattern))

    touches = lambda x, spans: F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    apart = lambda found, spans: F.zip_with(found, spans, lambda own, others: F.filter(own, lambda x: ~touches(x, others)))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.array_sort(F.concat(x, y)))
    content = F.col("text")
    cut = read.withColumn("segments", F.when(content.rlike(ANY), F.regexp_extract_all(content, F.lit(SEGMENT), F.lit(0))).otherwise(F.array().cast("array<string>")))
    scanned = cut.withColumns({"base": F.transform("segments", _base), "random": judged(CANDIDATE), "piece": judged(PIECE)})
    whole = scanned.withColumn("random", apart("random", "base"))
    return whole.withColumn("added", both("random", apart(F.col("piece"), both("random", "base")))).drop("random", "piece")


def find_secrets(docs: DataFrame, table: list[float], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): arrays of (start, kind, end) in order; ``kind`` is an index of ``KINDS``, ``added`` has the kind ``random``."""
    read = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    found = _segments(read, table).withColumn("at", _running(F.transform("segments", F.length)))
    moved = lambda s, at: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"))
    placed = lambda c: F.flatten(F.zip_with(c, "at", lambda spans, at: F.transform(spans, lambda s: moved(s, at))))
    return found.select(F.col("id").alias(key), placed("base").alias("base"), placed("added").alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by comma."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, table: list[float], *, text: str = "text", n_chars: str = "n_chars", mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``, overlapping spans by one, and ``n_chars`` brought up to date where there is such a column.

    Texts without spans stay as they are, null ones too.
    """
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs, text).alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cleaned(segment: Column, spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            before = F.substring(segment, acc["at"] + 1, s["start"] - acc["at"])
            fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit(mask)).alias("out"))
            longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            return F.when((s["start"] < acc["at"]) & (acc["at"] > 0), longer).otherwise(fresh)

        finish = lambda acc: F.concat(acc["out"], F.substring(segment, acc["at"] + 1, F.length(segment)))
        return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(segment)

    found = _segments(inner, table).withColumn("spans", F.zip_with("base", "added", lambda b, a: F.array_sort(F.concat(b, a))))
    clean = F.when(F.exists("spans", lambda s: F.size(s) > 0), F.concat_ws("", F.zip_with("segments", "spans", cleaned))).otherwise(F.col("row")[text])
    masked = found.select("row", clean.alias("__clean"))
    columns = [
        F.col("__clean").alias(c) if c == text else F.coalesce(F.when(F.col("__clean") != F.col("row")[text], F.length("__clean")), F.col("row")[c]).cast(dict(docs.dtypes)[c]).alias(c) if c == n_chars else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return masked.select(*columns)
