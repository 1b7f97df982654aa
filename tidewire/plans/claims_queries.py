"""Queries: evidence selection and claim validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators import claims, evidence
from tidewire.plans.ingest_queries import RANK
from tidewire.plans.registry import query
from tidewire.plans.story_queries import CENTROIDS, COS, LOW
from tidewire.plans.views import Views, with_views


@query(with_views(f"select a.story_id, a.id as a, b.id as b from articles a join articles b on a.story_id = b.story_id and a.id < b.id where a.status = 'auto_accepted' and b.status = 'auto_accepted' and a.embedding is not null and b.embedding is not null and 1 - {COS.format('a.embedding', 'b.embedding')} < 0.6", "articles"))
def near_duplicate_evidence(v: Views) -> DataFrame:
    """Pairs of a story that nearly say the same, at a similarity above 0.4."""
    return evidence.near_duplicate_pairs(evidence.ranked_candidates(v.articles), LOW)


def _picked(v: Views) -> DataFrame:
    return evidence.with_excerpts(evidence.select_evidence(evidence.ranked_candidates(v.articles), LOW), v.articles)


def picked_sql(near: float) -> str:
    """SQL frames up to ``picked``: the greedy pick written out, one frame a report."""
    clash = f"exists (select 1 from {{0}} h where h.story_id = r.story_id and (h.id = r.id or {COS.format('h.embedding', 'r.embedding')} > {near}))"
    row = "story_id, id, publisher_id, at_s, source_rank, embedding"
    frames = [
        CENTROIDS.strip(),
        f"dist as (select a.story_id, a.id, a.publisher_id, a.at_s, a.embedding, 1 - {COS.format('a.embedding', 'c.centroid')} as distance from articles a join c on a.story_id = c.story_id where a.status = 'auto_accepted' and a.embedding is not null and regexp_matches(a.body, '\\S'))",
        "r as materialized (select *, row_number() over (partition by story_id order by round(distance, 9), at_s, id) as source_rank from dist)",
        f"h1 as materialized (select {row}, 'earliest_reporting' as reason from r qualify row_number() over (partition by story_id order by at_s, id) = 1)",
        f"h2 as materialized (select * from h1 union all (select {row}, 'latest_reporting' from r where not {clash.format('h1')} qualify row_number() over (partition by story_id order by at_s desc, id desc) = 1))",
    ]
    for k in range(3, 11):
        held = f"h{k - 1}"
        frames.append(
            f"h{k} as materialized (select * from {held} union all (select {row}, 'centroid_rank' from r where (select count(*) from {held} h where h.story_id = r.story_id) < 10 "
            f"and (select count(*) from {held} h where h.story_id = r.story_id and h.publisher_id = r.publisher_id) < 2 and not {clash.format(held)} qualify row_number() over (partition by story_id order by source_rank) = 1))"
        )
    frames.append("picked as (select *, 'A' || cast(row_number() over (partition by story_id order by source_rank) as varchar) as evidence_id from h10)")
    return "with " + ", ".join(frames)


@query(with_views(f"{picked_sql(0.4)} select p.story_id, p.id, evidence_id, reason, source_rank, sha256(a.body) as content_hash from picked p join articles a using (id)", "articles"))
def selected_evidence(v: Views) -> DataFrame:
    """The bounded pick of each story."""
    return _picked(v).select("story_id", "id", "evidence_id", "reason", "source_rank", "content_hash")


EXCERPTED = """t as (select p.story_id, p.id, evidence_id, reason, source_rank, p.publisher_id, a.title, a.mode, a.body, replace(replace(trim(regexp_replace(a.body, '\\s+', ' ', 'g')), '[', '('), ']', ')') as whole from picked p join articles a using (id)),
s as (select *, substr(whole, 1, 1500) as head, strpos(reverse(substr(whole, 1, 1500)), ' ') as back from t),
x as (select *, case when length(whole) <= 1500 then whole else case when back > 0 and 1500 - back > 1300 then substr(head, 1, 1500 - back) else head end || '…' end as excerpt from s)"""


@query(
    with_views(
        f"""
{picked_sql(0.4)},
{EXCERPTED},
l as (select *, cast(to_json([evidence_id, cast(id as varchar), publisher_id, coalesce(title, ''), coalesce(excerpt, ''), coalesce(sha256(body), ''), mode, reason]) as varchar) as line from x)
select story_id, sha256(string_agg(line, chr(10) order by source_rank)) as set_hash, count(*)::int as article_count, count(distinct publisher_id)::int as publishers, arg_min(mode, {RANK}) as weakest_mode from l group by story_id
""",
        "articles",
    )
)
def frozen_evidence(v: Views) -> DataFrame:
    """Frozen sets with hash, counts and weakest mode."""
    return evidence.frozen_sets(_picked(v))


@query(with_views("select story_id, bool_or(id % 40 = 0) as changed from articles where status = 'auto_accepted' group by story_id", "articles"))
def changed_evidence(v: Views) -> DataFrame:
    """Frozen articles that read differently now."""
    members = v.articles.where("status = 'auto_accepted'")
    frozen = members.select("story_id", "id", F.sha2("body", 256).alias("content_hash"))
    now = v.articles.withColumn("body", F.when(F.col("id") % 40 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return evidence.frozen_changed(frozen, now)


@query("select doc_id // 3 as set_id, doc_id as id, 'A' || cast(row_number() over (partition by doc_id // 3 order by doc_id desc) as varchar) as evidence_id from documents")
def evidence_from_hits(v: Views) -> DataFrame:
    """Hits as evidence, in hit order."""
    ids = v.documents.groupBy(F.floor(F.col("doc_id") / 3).alias("set_id")).agg(F.reverse(F.array_sort(F.collect_list("doc_id"))).alias("ids"))
    return evidence.evidence_from_articles(ids, v.articles).select("set_id", "id", "evidence_id")


@query(with_views("select id, case when p.terms_class = 'licensed' or a.mode = 'feed_excerpt' then substr(a.body, 1, 20) end as shown from articles a join publishers p using (publisher_id)", "articles", "publishers"))
def servable_texts(v: Views) -> DataFrame:
    """Texts that may be shown."""
    rows = v.articles.join(v.publishers, "publisher_id")
    return rows.select("id", evidence.servable(F.substring("body", 1, 20), F.col("terms_class"), F.col("mode")).alias("shown"))


# answers by the remainder of the document's id; evidence A1, A2 from one publisher each and A3 from that of A1
CLAIM = '{{"text": "{0}", "claim_type": "{1}", "citations": [{2}]}}'
OWN = CLAIM.format("The lens matters.", "student_context", '"A1"')
AGREED = CLAIM.format("All agree.", "consensus", '" [a1] ", "A2", "a1"')
ANSWERS = [
    ('{"claims": [' + AGREED + ", " + OWN + "]}", None, 2),
    ("no object at all", "unparseable_output", 0),
    ('{"claims": []}', "schema_violation", 0),
    ('{"claims": [' + AGREED + ', {"text": "", "claim_type": "student_context", "citations": ["A1"]}]}', "schema_violation", 0),
    ('{"claims": [' + AGREED + ", " + CLAIM.format("Unknown.", "student_context", '"A9"') + "]}", "invalid_citations", 1),
    ('{"claims": [' + AGREED + ", " + OWN + ", " + CLAIM.format("Others omit this.", "consensus", '"A1"') + "]}", None, 2),
    ('{"claims": [' + AGREED + ", " + CLAIM.format("Investors should buy now.", "student_context", '"A1"') + "]}", "below_claim_floor", 1),
    ('<think>{"claims": 1}</think> ```json\n{"claims": [' + AGREED + ", " + OWN + ', {"text": "They differ.", "claim_type": "contradiction", "sides": {"supports": ["A1"], "contradicts": ["A2"]}}]}\n```', None, 3),
    ('{"claims": [' + AGREED + ", " + OWN + ', {"text": "They differ.", "claim_type": "contradiction", "sides": {"supports": ["A1"], "contradicts": ["A3"]}}]}', None, 2),
    ('{"claims": [' + AGREED + ", " + OWN + ", " + CLAIM.format("One source.", "source_specific", '"A1"') + "]}", None, 2),
    ('{"claims": [' + AGREED + ", " + OWN + ", " + CLAIM.format("Nothing cited.", "consensus", "") + "]}", None, 2),
    ('{"claims": [{"text": "x", "claim_type": "investor", "citations": ["A1"]}]}', "schema_violation", 0),
]


def _pairs(**values: object) -> Column:
    """An array of (k, v)."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()])


def _answers(v: Views) -> tuple[DataFrame, DataFrame]:
    raw = F.get(F.array(*[F.lit(a) for a, _, _ in ANSWERS]), (F.col("doc_id") % len(ANSWERS)).cast("int"))
    rows = v.documents.select(F.col("doc_id").alias("run_id"), raw.alias("raw"), F.lit("student_context").alias("lens"), F.lit(False).alias("full_text"), F.array(F.lit("consensus"), F.lit("contradiction")).alias("surfaced"))
    cited = F.explode(_pairs(A1=1, A2=2, A3=1))
    return rows, rows.select("run_id", cited.alias("x")).select("run_id", F.col("x.k").alias("evidence_id"), F.col("x.v").alias("publisher_id"))


_VALUES = ", ".join(f"({i}, {'null' if code is None else repr(code)}, {n})" for i, (_, code, n) in enumerate(ANSWERS))


@query(f"with a(k, failure_code, claims_accepted) as (values {_VALUES}) select doc_id as run_id, failure_code, claims_accepted from documents join a on k = doc_id % {len(ANSWERS)}")
def judged_answers(v: Views) -> DataFrame:
    """Failure code and accepted claims of every answer."""
    answers, cited = _answers(v)
    return claims.judged_runs(answers, claims.judged_claims(answers, cited)).select("run_id", "failure_code", "claims_accepted")


@query(
    f"""
with d(k, claim_index, code) as (values (3, 1, 'schema_violation'), (4, 1, 'unknown_evidence_id'), (5, 2, 'omission_language'), (6, 1, 'prohibited_investor_language'), (8, 2, 'unsupported_contradiction'), (9, 2, 'claim_type_not_requested'), (10, 2, 'claim_without_citation'), (11, 0, 'schema_violation'))
select doc_id as run_id, claim_index, code from documents join d on k = doc_id % {len(ANSWERS)}
"""
)
def dropped_claims(v: Views) -> DataFrame:
    """Why claims were dropped, by the first check that fails."""
    answers, cited = _answers(v)
    return claims.judged_claims(answers, cited).where("code is not null").select("run_id", "claim_index", "code")


@query("select user_id as run_id, sum(event_id % 5)::int as claims_returned, max(event_id)::int as repair_attempts, arg_max(event_type, event_id) as failure_code from events group by 1")
def repaired_answers(v: Views) -> DataFrame:
    """Repairs added up."""
    n = (F.col("event_id") % 5).alias("claims_returned")
    rows = v.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt"), n, F.lit(0).alias("claims_accepted"), F.lit(0).alias("claims_rejected"), F.array(F.lit("A9")).alias("unknown_evidence_ids"), F.col("event_type").alias("failure_code"))
    return claims.with_repairs(rows).select("run_id", "claims_returned", "repair_attempts", "failure_code")


@query("with r as (select o_orderkey as run_id, o_custkey % 20 as story_id, o_orderdate as at from orders where o_orderstatus = 'F' and o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0), k as (select *, row_number() over (partition by story_id order by at desc, run_id desc) as k from r) select story_id as wanted_id, run_id from k where k = 1".replace(" as at ", " as t ").replace("order by at desc", "order by t desc"))
def reusable_analyses(v: Views) -> DataFrame:
    """The latest run that answers a wanted one."""
    key = {"lens": "student_context", "prompt_version": "1", "provider": "p", "model": "m", "set_hash": "h"}
    runs = v.orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("story_id"), F.col("o_orderdate").alias("completed_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status")).withColumns({k: F.lit(x) for k, x in key.items()})
    wanted = runs.select("story_id", *key).distinct().withColumns({"wanted_id": F.col("story_id"), "surfaced": F.array(F.lit("consensus"))})
    typed = runs.select("run_id", F.when(F.col("run_id") % 5 == 0, "contradiction").otherwise("consensus").alias("claim_type"))
    return claims.reusable_runs(wanted, runs, typed, runs.where("run_id % 7 = 0").select("run_id"))


@query("select l_orderkey as run_id, l_linenumber as claim_index, ['A1', 'A2'] as evidence_ids, case when l_linenumber % 2 = 0 then ['A2'] end as contradicts from (select distinct l_orderkey, l_linenumber from lineitem)")
def claim_views(v: Views) -> DataFrame:
    """G19, G-d: claims with ordered citations and sides."""
    rows = v.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("claim_index"), F.when(F.col("l_linenumber") % 2 == 0, "contradiction").otherwise("consensus").alias("claim_type")).distinct()
    each = rows.select("run_id", "claim_index", F.explode(_pairs(A2="contradicts", A1="supports")).alias("x")).select("run_id", "claim_index", F.col("x.k").alias("evidence_id"), F.col("x.v").alias("relationship"))
    frozen = rows.select("run_id").distinct().select("run_id", F.explode(_pairs(A1=1, A2=2)).alias("x")).select("run_id", F.col("x.k").alias("evidence_id"), F.col("x.v").alias("article_id"), F.col("x.v").alias("source_rank"))
    return claims.claim_view(rows, each, frozen).select("run_id", "claim_index", "evidence_ids", F.col("sides.contradicts").alias("contradicts"))


@query("select o_orderkey as id, case when o_orderkey % 4 = 0 then 'text too long' when o_orderkey % 4 = 1 then 'claim count out of bounds' when o_orderkey % 4 = 2 then 'consensus is required' end as error from orders")
def template_checks(v: Views) -> DataFrame:
    """Prompt parameters checked."""
    k = F.col("o_orderkey") % 4
    rows = v.orders.select(F.col("o_orderkey").alias("id"), F.when(k == 0, F.repeat(F.lit("x"), F.lit(241))).otherwise("calm").alias("tone"), F.lit("").alias("lens_emphasis"), F.lit(2).alias("claim_min"), F.when(k == 1, 9).otherwise(5).alias("claim_max"), F.when(k == 2, F.array(F.lit("contradiction"))).otherwise(F.array(F.lit("contradiction"), F.lit("consensus"))).alias("surfaced"))
    return claims.template_errors(rows).select("id", "error")


@query("select 'v' || cast(o_orderkey as varchar) as version from orders where o_orderkey = 7")
def current_template(v: Views) -> DataFrame:
    """The template that is current after an activation, among as many versions as there are orders."""
    versions = v.orders.select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"), F.lit(False).alias("is_current"))
    return claims.current_template(claims.activated(versions, "v7"), "v1")


@query(
    with_views(
        f"""
{picked_sql(0.4)},
{EXCERPTED}
select story_id, 'Compare the reports below for a reader with the lens student_context. Cite evidence ids for every claim.' || chr(10) || chr(10) || string_agg('[' || evidence_id || '] ' || coalesce(title, '') || chr(10) || coalesce(excerpt, ''), chr(10) || chr(10) order by source_rank) as prompt from x group by story_id
""",
        "articles",
    )
)
def prompts(v: Views) -> DataFrame:
    """Prompts from the selected evidence."""
    return claims.prompts(_picked(v), "student_context")


@query("select doc_id, case doc_id % 5 when 0 then null when 1 then 'unparseable_output' when 2 then 'schema_violation' when 3 then 'prohibited_investor_language' else 'claim_without_citation' end as code from documents")
def market_reads(v: Views) -> DataFrame:
    """Market reads checked."""
    texts = ['{"read": "Prices rose.", "citations": ["A1"]}', "none", '{"read": " ", "citations": []}', '{"read": "News caused a fall.", "citations": ["[a1]"]}', '{"read": "News came.", "citations": [" "]}']
    raw = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("doc_id") % 5).cast("int"))
    return v.documents.select("doc_id", claims.market_read_code(raw, F.array(F.lit("A1"))).alias("code"))


@query("select doc_id as run_id, 0 as claim_index, case when doc_id % 2 = 0 then 'Second?' else 'What do these outlets agree on?' end as question from documents")
def card_questions(v: Views) -> DataFrame:
    """Questions with fallbacks."""
    rows = v.documents.select(F.col("doc_id").alias("run_id"), F.lit(0).alias("claim_index"), F.lit("consensus").alias("claim_type"))
    raw = F.when(F.col("doc_id") % 2 == 0, '{"questions": [{"number": 1, "question": "First?"}, {"number": 1, "question": " Second? "}]}').otherwise("nothing")
    return claims.questions(rows, v.documents.select(F.col("doc_id").alias("run_id"), raw.alias("raw")))


@query("select doc_id as run_id, 0 as position, case when doc_id % 3 = 0 then 'Q?' else 'What does source A1 report?' end as question, case when doc_id % 3 = 0 then 'Oil' else 'Given' end as answer, ['A1'] as citations from documents where doc_id % 3 < 2")
def answer_cards(v: Views) -> DataFrame:
    """Cards of answers, by evidence row; a worded card without a citation is left out."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, '{"cards": [{"question": " Q? ", "answer": "Oil price", "citations": ["A1", "A7", "A1"]}]}').when(k == 1, '{"cards": []}').otherwise('{"cards": [{"question": "Q?", "citations": ["A7"]}]}')
    rows = v.documents.select(F.col("doc_id").alias("run_id"), raw.alias("raw"))
    evidence_rows = rows.select("run_id", F.lit(0).alias("position"), F.lit("A1").alias("evidence_id"), F.lit("Given answer.").alias("answer"))
    return claims.search_cards(rows, evidence_rows, "one_word")
