"""Validation of model-written claims against frozen evidence.

Answers are (run_id, raw, lens, full_text boolean, surfaced array<string>), evidence is (run_id, evidence_id, publisher_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import CORE_CLAIMS, DEFAULT, Config
from tidewire.functions.modeljson import answer_object
from tidewire.functions.text import collapse

# Phrases by which a claim speaks of what a report leaves out.
OMISSION = [
    r"\bomit(?:s|ted|ting)?\b", r"\bomission\b", r"\bfail(?:s|ed)? to (?:mention|report|note|cover)\b", r"\b(?:does|do|did) not (?:mention|report|note|cover|discuss)\b",
    r"\bmakes no mention\b", r"\bno (?:mention|coverage) of\b", r"\bignor\w+\b", r"\bleaves out\b", r"\bsilent on\b", r"\bsays nothing about\b", r"\babsent from\b",
    r"\bmissing from\b", r"\boverlook(?:s|ed)?\b", r"\bneglect(?:s|ed)? to\b",
]
# Phrases of investment advice; the last list keeps letter case.
ADVICE = [
    r"\b(?:investors?|shareholders?|readers?|traders?|holders?|you|we)\b[^.]{0,40}\b(?:should|must|ought to)\b[^.]{0,40}\b(?:buy|sell|short|hold|invest|divest|exit|add|trim)\b",
    r"\b(?:recommend|advis|urg)\w*\b[^.]{0,40}\b(?:buy|sell|short|hold|invest|divest|exit)\b",
    r"\bconsider(?:ing)?\b[^.]{0,40}\b(?:accumulat\w*|buy|sell|short|hold|invest|divest|exit|add|trim)\b",
    r"^(?:buy|sell|short|hold|divest|exit)\b", r"\b(?:price|share|profit)\s+target\b", r"\btarget price\b", r"\bfair value (?:at|of)\s*\$", r"\b\d+\s*% (?:upside|downside)\b",
    r"\bentry point\b", r"\bstrong (?:buy|sell)\b",
]
ADVICE_CASED = [r"\bPT\s*\$"]
# Words by which a read claims a cause.
CAUSAL = ["caused", "causes", "led to", "drives", "drove", "because of", "due to"]
# What a card asks by default.
DEFAULT_QUESTIONS = {
    "consensus": "What do these outlets agree on?", "source_specific": "What does only one outlet report?", "contradiction": "Where does the reporting disagree?",
    "student_context": "What background does this story need?", "investor_implication": "What does this reporting imply for a market read?",
}


def speaks_of_omission(text: Column) -> Column:
    return text.rlike("(?i)(?:" + "|".join(OMISSION) + ")")


def gives_advice(text: Column) -> Column:
    return text.rlike("(?i)(?:" + "|".join(ADVICE) + ")") | text.rlike("|".join(ADVICE_CASED))


def evidence_ids(raw: Column) -> Column:
    """Cited ids: trimmed, a bracket off each side, upper case, blanks out, each once in order."""
    clean = lambda x: F.upper(F.trim(F.regexp_replace(F.trim(x), r"^\[|\]$", "")))
    return F.array_distinct(F.filter(F.transform(raw, clean), lambda x: x != ""))


def _strings(claim: Column, path: str) -> Column:
    """The strings of a JSON array, or null where it is none or holds something else."""
    part = F.try_variant_get(claim, path, "array<variant>")
    texts = F.transform(part, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.when(part.isNotNull() & ~F.exists(texts, lambda t: t.isNull()), texts)


def parsed_claims(answers: DataFrame) -> DataFrame:
    """Answers with ``object`` (variant or null) and ``items`` (array of claims or null)."""
    v = F.try_parse_json(answer_object(F.col("raw")))
    return answers.withColumn("object", v).withColumn("items", F.try_variant_get("object", "$.claims", "array<variant>"))


def judged_claims(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a claim: (run_id, lens, claim_index, claim_type, text, supports, contradicts, unknown, code); ``code`` is null for a claim that stands.

    The codes are tried in the order in which they are reported.
    """
    claims = parsed_claims(answers).select("run_id", "lens", "full_text", "surfaced", F.posexplode("items").alias("claim_index", "c"))
    string = lambda path: F.when(F.schema_of_variant(F.try_variant_get("c", path, "variant")) == "STRING", F.try_variant_get("c", path, "string"))
    rows = claims.withColumns({"text": string("$.text"), "claim_type": string("$.claim_type"), "cited": _strings(F.col("c"), "$.citations"), "pro": _strings(F.col("c"), "$.sides.supports"), "con": _strings(F.col("c"), "$.sides.contradicts")})
    contra = F.coalesce(F.col("claim_type") == "contradiction", F.lit(False))
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"supports": F.coalesce(evidence_ids(F.when(contra, F.col("pro")).otherwise(F.col("cited"))), empty), "contradicts": F.coalesce(F.when(contra, evidence_ids(F.col("con"))), empty)})
    known = evidence.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", "publisher_id"))).alias("known"))
    rows = rows.join(known, "run_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast(dict(known.dtypes)["known"])))
    every = F.concat("supports", "contradicts")
    rows = rows.withColumn("unknown", F.array_except(every, F.map_keys("known")))
    publisher = lambda ids: F.transform(ids, lambda i: F.try_element_at("known", i))
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    allowed = F.coalesce(F.col("claim_type").isin(CORE_CLAIMS) | (F.col("claim_type") == F.col("lens")), F.lit(False))
    malformed = contra & (F.col("pro").isNull() | F.col("con").isNull())
    omission = ~F.col("full_text") & speaks_of_omission(F.col("text"))
    code = (
        F.when(blank | ~allowed | (~contra & F.col("cited").isNull()), "schema_violation")
        .when(malformed & omission, "omission_language")
        .when(malformed, "unsupported_contradiction")
        .when(contra & ((F.size("supports") == 0) | (F.size("contradicts") == 0) | F.arrays_overlap("supports", "contradicts")), "unsupported_contradiction")
        .when(F.size(every) == 0, "claim_without_citation")
        .when(F.size("unknown") > 0, "unknown_evidence_id")
        .when(omission, "omission_language")
        .when(gives_advice(F.col("text")), "prohibited_investor_language")
        .when(contra & F.arrays_overlap(publisher(F.col("supports")), publisher(F.col("contradicts"))), "unsupported_contradiction")
        .when((F.col("claim_type") != F.col("lens")) & ~F.array_contains("surfaced", F.col("claim_type")), "claim_type_not_requested")
    )
    return rows.select("run_id", "lens", "claim_index", "claim_type", F.trim("text").alias("text"), "supports", "contradicts", F.when(code == "unknown_evidence_id", F.col("unknown")).otherwise(empty).alias("unknown"), code.alias("code"))


def judged_runs(answers: DataFrame, judged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(run_id, claims_returned, claims_accepted, claims_rejected, unknown_evidence_ids, failure_code) of every answer."""
    good = F.col("code").isNull()
    per_run = judged.groupBy("run_id").agg(
        F.count("*").cast("int").alias("n"), F.count_if(good).cast("int").alias("ok"), F.some(F.col("code") == "schema_violation").alias("broken"), F.some(good & (F.col("claim_type") == "consensus")).alias("consensus"),
        F.some(good & (F.col("claim_type") == F.col("lens"))).alias("own"), F.some(F.col("code").isin("claim_without_citation", "unknown_evidence_id")).alias("uncited"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown")))).alias("ids"),
    )
    met = parsed_claims(answers).select("run_id", F.col("object").isNull().alias("unreadable"), (F.schema_of_variant("object").startswith("OBJECT")).alias("is_object"), F.coalesce(F.size("items"), F.lit(0)).alias("size")).join(per_run, "run_id", "left")
    broken = (F.col("size") < 1) | F.coalesce("broken", F.lit(False))
    short = (F.col("ok") < cfg.min_claims) | ~F.col("consensus") | ~F.col("own")
    failure = F.when(F.col("unreadable") | ~F.col("is_object"), "unparseable_output").when(broken, "schema_violation").when(short & F.col("uncited"), "invalid_citations").when(short, "below_claim_floor")
    whole = F.coalesce(failure.isin("unparseable_output", "schema_violation"), F.lit(False))
    returned = F.greatest(F.col("size"), F.lit(0))
    return met.select(
        "run_id", F.when(failure == "unparseable_output", 0).otherwise(returned).alias("claims_returned"), F.when(whole, 0).otherwise(F.col("ok")).alias("claims_accepted"),
        F.when(failure == "unparseable_output", 0).when(whole, returned).otherwise(returned - F.col("ok")).alias("claims_rejected"), F.when(whole | F.col("ids").isNull(), F.array().cast("array<string>")).otherwise(F.col("ids")).alias("unknown_evidence_ids"), failure.alias("failure_code"),
    )


def with_repairs(attempts: DataFrame) -> DataFrame:
    """(run_id, sums, unknown ids, repair_attempts, failure_code) over a run's attempts (run_id, attempt, ..), of which the last decides."""
    return attempts.groupBy("run_id").agg(
        *[F.sum(c).cast("int").alias(c) for c in ("claims_returned", "claims_accepted", "claims_rejected")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown_evidence_ids")))).alias("unknown_evidence_ids"),
        F.max("attempt").cast("int").alias("repair_attempts"), F.max_by("failure_code", "attempt").alias("failure_code"),
    )


REUSE_KEY = ["story_id", "lens", "prompt_version", "provider", "model", "set_hash"]


def reusable_runs(wanted: DataFrame, runs: DataFrame, claims: DataFrame, legacy: DataFrame) -> DataFrame:
    """Wanted runs with the latest completed one that answers them: same key, no legacy snapshot, no core claim outside the wanted types."""
    done = runs.where("status = 'completed'").join(legacy.select("run_id"), "run_id", "left_anti")
    met = wanted.join(done.select("run_id", "completed_at", *REUSE_KEY), REUSE_KEY)
    outside = met.join(claims.where(F.col("claim_type").isin(CORE_CLAIMS)).select("run_id", "claim_type"), "run_id").where(~F.array_contains("surfaced", F.col("claim_type"))).select("wanted_id", "run_id").distinct()
    return met.join(outside, ["wanted_id", "run_id"], "left_anti").groupBy("wanted_id").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def claim_view(claims: DataFrame, citations: DataFrame, frozen: DataFrame) -> DataFrame:
    """Claims with their citations in rank order; a contradiction has two sides, or null where a side is missing."""
    rows = citations.join(frozen.select("run_id", "evidence_id", "article_id", "source_rank"), ["run_id", "evidence_id"])
    side = lambda name: F.transform(F.filter("all", lambda x: x["relationship"] == name), lambda x: x["evidence_id"])
    grouped = rows.groupBy("run_id", "claim_index").agg(F.array_sort(F.collect_list(F.struct("source_rank", "evidence_id", "article_id", "relationship"))).alias("all"))
    met = claims.join(grouped, ["run_id", "claim_index"], "left")
    both = (F.size(side("supports")) > 0) & (F.size(side("contradicts")) > 0) & (F.col("claim_type") == "contradiction")
    return met.select(*claims.columns, F.transform("all", lambda x: x["evidence_id"]).alias("evidence_ids"), F.transform("all", lambda x: x["article_id"]).alias("article_ids"), F.when(both, F.struct(side("supports").alias("supports"), side("contradicts").alias("contradicts"))).alias("sides"))


def template_errors(rows: DataFrame) -> DataFrame:
    """Prompt parameters (tone, lens_emphasis, claim_min, claim_max, surfaced) with the first ``error`` and surfaced types in their fixed order."""
    ordered = F.filter(F.array(*[F.lit(c) for c in CORE_CLAIMS]), lambda c: F.array_contains("surfaced", c))
    error = (
        F.when((F.length("tone") > 240) | (F.length("lens_emphasis") > 240), "text too long")
        .when(~((F.col("claim_min") >= 2) & (F.col("claim_min") <= F.col("claim_max")) & (F.col("claim_max") <= 8)), "claim count out of bounds")
        .when(F.size(F.array_except("surfaced", F.array(*[F.lit(c) for c in CORE_CLAIMS]))) > 0, "unknown claim type")
        .when(~F.array_contains("surfaced", F.lit("consensus")), "consensus is required")
    )
    return rows.withColumns({"error": error, "surfaced": ordered})


def current_template(templates: DataFrame, default_version: str) -> DataFrame:
    """One row: the version that is current, or the one that is shipped."""
    return templates.where("is_current").agg(F.coalesce(F.max("version"), F.lit(default_version)).alias("version"))


def activated(templates: DataFrame, version: str) -> DataFrame:
    return templates.withColumn("is_current", F.col("version") == version)


def prompts(evidence: DataFrame, lens: str, tone: str = "") -> DataFrame:
    """(story_id, prompt): instructions and the evidence blocks in rank order."""
    block = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("source_rank", block.alias("block")))), lambda x: x["block"])
    head = f"Compare the reports below for a reader with the lens {lens}. Cite evidence ids for every claim." + (f" {tone}" if tone else "")
    return evidence.groupBy("story_id").agg(F.concat_ws("\n\n", F.lit(head), F.array_join(ordered, "\n\n")).alias("prompt"))


def market_read_code(raw: Column, known: Column) -> Column:
    """The first fault of a market read, or null: JSON, text, string citations, at least one, known ids, no advice, no causal verbs."""
    v = F.try_parse_json(answer_object(raw))
    text, cited = F.try_variant_get(v, "$.read", "string"), _strings(v, "$.citations")
    return (
        F.when(v.isNull(), "unparseable_output")
        .when(F.coalesce(F.trim(text) == "", F.lit(True)) | cited.isNull(), "schema_violation")
        .when(F.size(evidence_ids(cited)) == 0, "claim_without_citation")
        .when(F.size(F.array_except(evidence_ids(cited), known)) > 0, "unknown_evidence_id")
        .when(gives_advice(text) | text.rlike(r"(?i)\b(?:" + "|".join(CAUSAL) + r")\b"), "prohibited_investor_language")
    )


def questions(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, claim_index, question): a model's question by number, 200 characters at most, the later of two; else that of the claim's type."""
    listed = F.try_variant_get(F.try_parse_json(answer_object(F.col("raw"))), "$.questions", "array<struct<number:int,question:string>>")
    each = answers.select("run_id", F.posexplode(listed).alias("at", "q")).select("run_id", "at", (F.col("q.number") - 1).alias("claim_index"), collapse(F.col("q.question")).alias("question"))
    given = each.where(F.length("question").between(1, 200)).groupBy("run_id", "claim_index").agg(F.max_by("question", "at").alias("question"))
    usual = F.coalesce(*[F.when(F.col("claim_type") == k, F.lit(v)) for k, v in DEFAULT_QUESTIONS.items()], F.lit("What does this claim say?"))
    return claims.join(given, ["run_id", "claim_index"], "left").select("run_id", "claim_index", F.coalesce("question", usual).alias("question"))


def search_cards(answers: DataFrame, evidence: DataFrame, length: str = "full") -> DataFrame:
    """(run_id, position, question, answer, citations): a card for each evidence row (run_id, position from 0, evidence_id, answer).

    A worded card that cites none of the run's ids is left out; what a card leaves empty comes from its evidence row.
    The answer is cut to a word or a line where that ``length`` is asked for.
    """
    known = evidence.groupBy("run_id").agg(F.collect_set("evidence_id").alias("known"))
    cards = F.try_variant_get(F.try_parse_json(answer_object(F.col("raw"))), "$.cards", "array<variant>")
    met = evidence.join(answers.select("run_id", cards.alias("cards")), "run_id", "left").join(known, "run_id").withColumn("card", F.get("cards", F.col("position")))
    word = lambda path: F.coalesce(F.trim(F.try_variant_get("card", path, "string")), F.lit(""))
    cited = F.coalesce(F.try_variant_get("card", "$.citations", "array<string>"), F.array().cast("array<string>"))
    rows = met.select("run_id", "position", "evidence_id", F.col("answer").alias("given"), word("$.question").alias("q"), word("$.answer").alias("a"), F.array_distinct(F.filter(cited, lambda c: F.array_contains("known", c))).alias("c"))
    rows = rows.where((F.size("c") > 0) | ((F.col("q") == "") & (F.col("a") == "")))
    text = F.coalesce(F.nullif("a", F.lit("")), "given")
    cut = {"one_word": F.get(F.split(F.trim(text), r"\s+"), F.lit(0)), "one_line": F.trim(F.get(F.split(text, r"[\n.!?]"), F.lit(0))), "full": text}[length]
    question = F.when(F.col("q") == "", F.concat(F.lit("What does source "), "evidence_id", F.lit(" report?"))).otherwise(F.col("q"))
    return rows.select("run_id", "position", question.alias("question"), cut.alias("answer"), F.when(F.size("c") > 0, F.col("c")).otherwise(F.array("evidence_id")).alias("citations"))
