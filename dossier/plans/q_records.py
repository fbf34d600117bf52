"""Registered queries: responses, reports, narratives, lookups, feedback, profiles, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import narrative as nv
from dossier.functions import reports as rp
from dossier.functions import responses as rs
from dossier.functions import text as tx
from dossier.operators import feedback as fb
from dossier.operators import profiles as pf
from dossier.operators import relational as rel
from dossier.operators import sessions as ss
from dossier.operators.retrieval import first_seen
from dossier.plans import adapters
from dossier.plans.adapters import CASES_REVIEW_SQL, MESSAGES_SQL
from dossier.plans.oracle import strip
from dossier.plans.registry import query
from dossier.sources.readers import read_table

# ---- responses ---------------------------------------------------------------------------------


def _responses(spark, d):
    """Event properties wrapped the ways a response can come."""
    e, p = F.col("event_id"), F.col("props")
    raw = (
        F.when(e % 5 == 0, p)
        .when(e % 5 == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nbye")))
        .when(e % 5 == 2, F.concat(F.lit("<JSON> "), p, F.lit(" </JSON>")))
        .when(e % 5 == 3, F.concat(F.lit("the answer is "), p, F.lit(" I think")))
        .otherwise(F.concat(F.lit("broken "), F.substring(p, 1, 5)))
    )
    return read_table(spark, d, "events").select("event_id", "event_type", "props", raw.alias("raw"))


@query(
    "H24 U3 S8",
    """select event_id, case when event_id % 5 < 4 then (props->>'k')::int end as k, case when event_id % 5 = 4 then 'parsing_failed' end as error from events""",
)
def json_extract(spark, d):
    r = _responses(spark, d).withColumn("j", rs.extract_json(F.col("raw")))
    return r.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), F.when(F.col("j").isNull(), "parsing_failed").alias("error"))


@query(
    "U4",
    """select event_id, case when event_id % 5 < 4 then 'first' when event_id % 2 = 0 then 'retry' else 'default' end as used, event_id % 5 = 4 and event_id % 2 = 0 as retry_used,
       event_id % 5 = 4 and event_id % 2 = 1 as deterministic_fallback from events""",
)
def response_retry(spark, d):
    r = _responses(spark, d)
    second = F.when(F.col("event_id") % 2 == 0, '{"r": 1}').otherwise("no")
    got = rs.first_response(F.col("raw"), second, F.lit('{"d": 1}'))
    out = r.select("event_id", got["payload"].alias("p"), got["retry_used"].alias("retry_used"), got["deterministic_fallback"].alias("deterministic_fallback"))
    used = F.when(F.get_json_object("p", "$.r").isNotNull(), "retry").when(F.get_json_object("p", "$.d").isNotNull(), "default").otherwise("first")
    return out.select("event_id", used.alias("used"), "retry_used", "deterministic_fallback")


@query(
    "H25",
    f"""with x as (select doc_id, list_transform(string_split(text, chr(10)), lambda v: {strip("v")}) as l from documents)
    select doc_id, md5(list_aggregate(list_transform(l, lambda v, i: case when i % 3 = 2 then '' else v end), 'string_agg', '|')) as digest from x""",
)
def numbered_list(spark, d):
    """Document lines as a numbered reply in which every third number is missing."""
    lines = F.transform(F.split("text", "\n"), tx.strip)
    reply = F.transform(
        lines, lambda v, i: F.when(i % 3 != 1, F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise(") "), v)).otherwise("noise")
    )
    docs = read_table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), F.array_join(reply, "\n").alias("t"))
    return docs.select("doc_id", F.md5(F.array_join(rs.numbered_list(F.col("t"), F.col("n")), "|")).alias("digest"))


@query("D3", "select event_id, case when event_id % 2 = 0 then '' else 'j' end as missing from events")
def required_keys(spark, d):
    j = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", "\\}$", ', "j": 1}')).otherwise(F.col("props"))
    return read_table(spark, d, "events").select("event_id", F.array_join(rs.missing_keys(j, ("k", "j")), ",").alias("missing"))


@query(
    "H60",
    """select event_id, case when event_id % 3 = 0 then props when event_id % 3 = 1 then props else 'x ' || props end as text from events""",
)
def fence_strip(spark, d):
    e, p = F.col("event_id"), F.col("props")
    raw = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e % 3 == 1, F.concat(F.lit(" ```"), p, F.lit("```tail"))).otherwise(F.concat(F.lit("x "), p))
    return read_table(spark, d, "events").select("event_id", tx.strip_fence(raw).alias("text"))


@query(
    "H57 H58",
    f"""with x as (select doc_id, source, {strip('text')} as t, list_filter(string_split(text, chr(10)), lambda z: {strip('z')} <> '') as l from documents),
    r as (
      select doc_id, lower(source) || '::definition' as id, 'Symptom: ' || source || chr(10) || 'Section: DEFINITION' || chr(10) || chr(10) || t as body from x where t <> ''
      union all
      select doc_id, lower(source) || '::red_flags', 'Symptom: ' || source || chr(10) || 'Section: RED FLAGS' || chr(10) || chr(10)
        || list_aggregate(list_transform(l, lambda z: '- ' || z), 'string_agg', chr(10)) from x where len(l) > 0 and doc_id % 2 = 0)
    select doc_id, id, md5(body) as digest from r""",
)
def record_fanout(spark, d):
    lines = F.split("text", "\n")
    flags = F.when(F.col("doc_id") % 2 == 0, nv.bullets(lines)).otherwise(F.lit(""))
    fields = {"one_sentence_definition": tx.strip(F.col("text")), "red_flags": flags}
    r = read_table(spark, d, "documents").select("doc_id", F.explode(nv.record_rows(fields, F.col("source"))).alias("r"))
    return r.select("doc_id", "r.id", F.md5("r.text").alias("digest"))


@query(
    "H58",
    """select doc_id, md5('Symptom: ' || source || chr(10) || 'Definition: ' || lang || chr(10) || 'Red flags:' || chr(10)
       || list_aggregate(list_transform(string_split(text, chr(10)), lambda z: '- ' || z), 'string_agg', chr(10))) as digest from documents""",
)
def record_blob(spark, d):
    doc = nv.record_document(F.col("source"), F.col("lang"), {"red_flags": F.split("text", "\n")})
    return read_table(spark, d, "documents").select("doc_id", F.md5(doc).alias("digest"))


@query(
    "J22 D9",
    """with x as (select upper(source) as name, count(*)::int as a_items, count(l.doc_id)::int as b_items from documents d left join labels l on l.doc_id = d.doc_id group by source)
    select name, a_items, b_items, abs(a_items - b_items) as gap, abs(a_items - b_items) >= 3 as flagged from x where b_items > 0""",
)
def output_comparison(spark, d):
    """List lengths of two models' outputs side by side, matched on the upper-case name."""
    docs = read_table(spark, d, "documents").withColumn("name", F.upper("source"))
    a = docs.groupBy("name").agg(F.count("*").cast("int").alias("a_items"))
    labelled = docs.join(read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    b = labelled.groupBy(F.lower("source").alias("other")).agg(F.count("*").cast("int").alias("b_items"))
    j = a.join(b, F.col("name") == F.upper("other"))
    gap = F.abs(F.col("a_items") - F.col("b_items"))
    return j.select("name", "a_items", "b_items", gap.alias("gap"), (gap >= 3).alias("flagged"))


# ---- reports -----------------------------------------------------------------------------------


@query("H19", f"with {CASES_REVIEW_SQL} select case_id, system_primary_diagnosis || '**' as finding from review")
def primary_line(spark, d):
    return adapters.review_cases(spark, d).select("case_id", rp.primary_line(F.col("report")).alias("finding"))


@query("H20", f"with {CASES_REVIEW_SQL} select case_id, '**' || system_primary_diagnosis || '**' as finding from review")
def primary_clean(spark, d):
    return adapters.review_cases(spark, d).select("case_id", rp.primary_clean(F.col("report")).alias("finding"))


_SEC = "regexp_extract(report, '(?:#+\\s*)?{n}\\s*\n(.*?)(\n#+\\s|\\z)', 1, 'is')"


@query(
    "H21 H22 H23",
    f"""with {CASES_REVIEW_SQL} select case_id, md5({strip(_SEC.format(n='Clinical Reasoning'))}) as history, {strip(_SEC.format(n='Recommended'))} as recommended_action,
      {strip(_SEC.format(n='Primary Diagnosis'))} as suspected, urgency as urgency_level,
      md5(left({strip("regexp_replace(report, '(?:#+\\s*)?Clinical Reasoning\\s*\n.*?(\n#+\\s|\\z)', '\\1', 'is')")}, 2000)) as summary
      from review where not contains(lower(text_), 'x' || chr(1))""".replace("where not contains(lower(text_), 'x' || chr(1))", ""),
)
def report_rows(spark, d):
    c = adapters.review_cases(spark, d)
    r = c.select("case_id", *rp.report_row(F.col("report"), F.col("urgency")))
    return r.select("case_id", F.md5("history").alias("history"), "recommended_action", "suspected", "urgency_level", F.md5("summary_text").alias("summary"))


# ---- narratives --------------------------------------------------------------------------------

_LIST = "string_split(left(text, 60), ' ')"


def _narr(spark, d):
    lst = F.split("text", " ")
    qa = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("onset_time"), F.col("text"), F.lit("pain"), F.lit("yes"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = adapters.messages(spark, d).withColumnRenamed("content", "text")
    return m.withColumn("lst", lst).withColumn("qa", qa)


_QA = "chr(10) || 'Patient interview responses:' || chr(10) || '  Q: onset_time' || chr(10) || '  A: ' || content || chr(10) || '  Q: pain' || chr(10) || '  A: yes'"


@query(
    "H63",
    f"""with {MESSAGES_SQL} select session_id, turn, md5('Presenting symptoms: ' || replace(content, ' ', ', ') || case when turn % 2 = 0 then {_QA} else '' end
      || chr(10) || 'Urgency: ' || urgency || chr(10) || 'Patient complaint: ' || sender) as digest from messages""",
)
def narrative_text(spark, d):
    none = F.expr("cast(array() as array<string>)")
    t = nv.conversation_text(F.col("lst"), F.col("qa"), none, F.col("urgency"), F.col("sender"), F.expr("cast(map() as map<string,string>)"))
    return _narr(spark, d).select("session_id", "turn", F.md5(t).alias("digest"))


_FQ = "'Patient presenting with: ' || replace(content, ' ', ', ') || '. Urgency: ' || urgency || '.' || case when turn % 2 = 0 then ' Clinical findings:   - onset time: ' || content || '   - pain: yes' else '' end || ' Red flags present: ' || sender || '.'"


@query(
    "H55",
    f"""with {MESSAGES_SQL} select session_id, turn, md5({_FQ}) as query, md5({_FQ} || ' Additional context: ' || case when turn % 2 = 0 then 'onset_time: ' || content || ' pain: yes' else '' end) as enriched,
      md5('Patient complaint: ' || sender || '.' || case when turn % 2 = 0 then ' Patient history from follow-up questions:   - onset_time: ' || content || '   - pain: yes' else '' end) as refined from messages""",
)
def retrieval_queries(spark, d):
    n = _narr(spark, d)
    base = nv.finding_query(F.col("lst"), F.col("urgency"), F.col("qa"), F.array("sender"))
    return n.select(
        "session_id", "turn", F.md5(base).alias("query"), F.md5(nv.enriched_query(base, F.col("qa"))).alias("enriched"),
        F.md5(nv.refined_query(F.col("sender"), F.col("qa"))).alias("refined"),
    )


@query(
    "H59 H63 T11",
    f"""with {MESSAGES_SQL} select session_id, turn, md5('Presenting symptoms: N/A' || chr(10) || 'Urgency level: ' || upper(urgency) || chr(10) || chr(10) || 'Clinical findings:' || chr(10) || '  (none recorded)'
       || chr(10) || chr(10) || 'Red flags:' || chr(10) || '  - ' || sender || ' [routine]') as block,
       case urgency when 'emergency' then 'EMERGENCY — activate emergency response immediately.' when 'urgent' then 'see ' || sender else 'Routine clinical assessment.' end as action from messages""",
)
def finding_blocks(spark, d):
    m = adapters.messages(spark, d)
    flags = F.array(
        F.struct(F.lit("").alias("flag"), F.lit("urgent").alias("urgency")), F.struct(F.col("sender").alias("flag"), F.lit(None).cast("string").alias("urgency"))
    )
    rules = F.array(
        F.struct(F.lit("routine").alias("urgency"), F.lit("wait").alias("action")),
        F.struct(F.lit("urgent").alias("urgency"), F.concat(F.lit("see "), "sender").alias("action")),
        F.struct(F.lit("urgent").alias("urgency"), F.lit("later").alias("action")),
    )
    block = nv.finding_block(F.expr("cast(array() as array<string>)"), F.col("urgency"), F.expr("cast(map() as map<string,string>)"), nv.clean_flags(flags), F.lit(""))
    return m.select("session_id", "turn", F.md5(block).alias("block"), nv.first_urgent_action(F.col("urgency"), rules).alias("action"))


@query(
    "H64",
    """select conv_id, turn, 'a=' || role || ',b=' || (case when turn % 2 = 0 then 'new' else 'old' end) as answers, array_to_string(string_split(text, ' ')[1:3], '|') as followups from conversations""",
)
def merged_answers(spark, d):
    old = F.create_map(F.lit("a"), F.col("role"), F.lit("b"), F.lit("old"))
    new = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = nv.merge_answers(old, new)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return read_table(spark, d, "conversations").select("conv_id", "turn", shown.alias("answers"), F.array_join(nv.capped_followups(F.split("text", " ")), "|").alias("followups"))


# ---- lookups -----------------------------------------------------------------------------------


@query("J4 A28", "select c_custkey as report_id from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def pending_anti_join(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("report_id"))
    return rel.pending_reports(c, read_table(spark, d, "orders").select(F.col("o_custkey").alias("report_id")))


@query(
    "J3 J4 A28",
    """with rep as (select o_orderkey as report_id, o_custkey % 50 as doctor_id from orders), fbk as (select distinct l_orderkey as report_id from lineitem where l_returnflag = 'R'),
    a as (select c_custkey % 50 as doctor_id, count(*) as patients_assigned from customer group by 1),
    p as (select doctor_id, count(*) as reports_pending from rep where report_id not in (select report_id from fbk) group by 1)
    select coalesce(a.doctor_id, p.doctor_id) as doctor_id, coalesce(patients_assigned, 0) as patients_assigned, coalesce(reports_pending, 0) as reports_pending from a full join p on a.doctor_id = p.doctor_id""",
)
def doctor_dashboard(spark, d):
    patients = read_table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("doctor_id"))
    reports = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 50).alias("doctor_id"))
    fbk = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("report_id"))
    return rel.dashboard(patients, reports, fbk)


@query(
    "J5 J6 J9 S15",
    "select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
)
def name_lookup_chain(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = rel.lookup_chain(
        o,
        (read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"),
        (read_table(spark, d, "nation"), "c_nationkey", "n_nationkey"),
        (read_table(spark, d, "region"), "n_regionkey", "r_regionkey"),
    )
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("J3 J6", "select o_orderkey, s_name, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey")
def inner_lookup(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey")
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    j = rel.lookup_chain(o, (li, "o_orderkey", "l_orderkey"), (read_table(spark, d, "supplier").select("s_suppkey", "s_name"), "l_suppkey", "s_suppkey"), how="inner")
    return j.select("o_orderkey", "s_name", "l_linenumber", "l_quantity")


@query(
    "J7",
    "select distinct o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey or o_custkey = c_custkey + c_nationkey",
)
def or_key_join(spark, d):
    people = read_table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") + F.col("c_nationkey")).alias("user_id"))
    req = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rel.match_either_key(req, people, "o_custkey", ("c_custkey", "user_id")).select("o_orderkey", "c_custkey").distinct()


@query(
    "J8",
    "select o_orderkey as session_id, coalesce(s.s_suppkey, (select min(s_suppkey) from supplier)) as doctor_id from orders left join supplier s on s.s_suppkey = o_custkey",
)
def assigned_doctor(spark, d):
    sessions = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("patient_id"))
    sup = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("doctor_id"))
    assigned = sup.select(F.col("doctor_id").alias("patient_id"), F.col("doctor_id").alias("assigned_doctor"))
    return rel.assigned_or_any(sessions, assigned, sup).select("session_id", "doctor_id")


@query(
    "J10",
    f"""with {CASES_REVIEW_SQL}, f as (select event_id as feedback_id, 'Person ' || (user_id % 200) as patient_name, row_number() over (partition by user_id % 200 order by event_id) as nth from events),
    p as (select case_id, patient_name, row_number() over (partition by patient_name order by case_id) as nth from review where review_status = 'pending')
    select feedback_id, case_id from f left join p using (patient_name, nth)""",
)
def first_pending_case(spark, d):
    f = read_table(spark, d, "events").select(F.col("event_id").alias("feedback_id"), F.concat(F.lit("Person "), (F.col("user_id") % 200).cast("string")).alias("patient_name"))
    cases = adapters.review_cases(spark, d).select("case_id", "patient_name", "review_status")
    return rel.match_pending_cases(f, cases).select("feedback_id", "case_id")


@query(
    "W10",
    """with s as (select o_custkey, arg_max(case when o_orderstatus <> 'O' then o_orderkey end, (o_orderdate, o_orderkey)) as x, max(o_orderdate) as last_started_at,
      max((o_orderdate, o_orderkey)) as m from orders group by o_custkey)
    select c_custkey as patient_id, o.o_orderkey as last_session, s.last_started_at from customer left join s on s.o_custkey = c_custkey
    left join orders o on o.o_orderkey = s.m[2] and o.o_orderstatus <> 'O'""",
)
def latest_session(spark, d):
    ended = F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey"))
    s = read_table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("session_id"), ended.alias("ended_at"))
    p = read_table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    return rel.latest_session(p, s).select("patient_id", F.col("last_ended_at").alias("last_session"), "last_started_at")


@query(
    "W11 T6",
    "select o_custkey, o_orderkey, back from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as back from orders) where back <= 3",
)
def last_three(spark, d):
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rel.last_n(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "back")


@query("P12 P13", f"with {MESSAGES_SQL} select session_id, turn, sender from messages where message_type <> 'diagnosis'")
def patient_view(spark, d):
    m = adapters.messages(spark, d).select("session_id", "turn", "sender", "message_type")
    return rel.patient_messages(m).select("session_id", "turn", "sender")


@query("P15 T6", "select c_name from customer where contains(lower(c_name), '#0000000') order by c_name")
def name_search(spark, d):
    return read_table(spark, d, "customer").filter(F.lower("c_name").contains("#0000000")).select("c_name").orderBy("c_name")


@query("J17", "select distinct lang from documents where lower(lang) in (select lower(role) from conversations union select 'EN' union select 'fr') or lower(lang) in ('en', 'fr')")
def catalogue_names(spark, d):
    named = read_table(spark, d, "documents").select("lang").distinct()
    known = named.select(F.upper("lang").alias("k")).filter("k in ('EN', 'FR')")
    return named.join(known, F.lower("lang") == F.lower("k"), "left_semi")


# ---- feedback ----------------------------------------------------------------------------------


@query(
    "A25 P14",
    f"""with {CASES_REVIEW_SQL} select count(*) as total_cases, count(*) filter (where review_status = 'pending') as pending_review, count(*) filter (where review_status = 'confirmed') as confirmed,
      count(*) filter (where review_status = 'rejected') as rejected, round(count(*) filter (where review_status = 'confirmed')::double / nullif(count(*) filter (where review_status <> 'pending'), 0), 4) as confirmation_rate from review""",
)
def feedback_stats(spark, d):
    return fb.statistics(adapters.review_cases(spark, d))


@query("A25 T8", f"with {CASES_REVIEW_SQL} select system_primary_diagnosis as system_diagnosis, count(*) as n from review where review_status = 'rejected' group by all order by n desc, system_diagnosis limit 10")
def common_corrections(spark, d):
    return fb.common_corrections(adapters.review_cases(spark, d))


@query(
    "S9 P14",
    f"""with {CASES_REVIEW_SQL} select case_id, md5(case when review_status = 'confirmed' then report else coalesce(doctor_diagnosis, report) end) as expected, review_status = 'confirmed' as was_correct
      from review where review_status <> 'pending'""",
)
def training_export(spark, d):
    return fb.training_rows(adapters.review_cases(spark, d)).select("case_id", F.md5("expected_output").alias("expected"), "was_correct")


_REV = """rv as (select event_id as review_id, event_id % (select count(*) from documents) as case_id, case event_id % 3 when 0 then 'confirmed' when 1 then 'rejected' else 'maybe' end as decision,
  case when event_id % 2 = 0 then 'dx' || (event_id % 5) else '' end as dx, ts from events)"""


def _reviews(spark, d):
    e = F.col("event_id")
    n = read_table(spark, d, "documents").count()
    return read_table(spark, d, "events").select(
        e.alias("review_id"), (e % n).alias("case_id"),
        F.when(e % 3 == 0, " Confirmed").when(e % 3 == 1, "rejected").otherwise("maybe").alias("doctor_decision"),
        F.when(e % 2 == 0, F.concat(F.lit("dx"), (e % 5).cast("string"))).otherwise("").alias("doctor_diagnosis"),
        F.col("ts").alias("reviewed_at"),
    )


@query(
    "X4 S12",
    f"""with {CASES_REVIEW_SQL}, {_REV}, l as (select case_id, arg_max((decision, dx), (ts, review_id)) as r from rv where decision = 'confirmed' or (decision = 'rejected' and dx <> '') group by case_id)
    select case_id, coalesce(l.r[1], review_status) as review_status, case when l.r is not null then nullif(l.r[2], '') else doctor_diagnosis end as doctor_diagnosis from review left join l using (case_id)""",
)
def review_upsert(spark, d):
    cases = adapters.review_cases(spark, d).select("case_id", "review_status", "doctor_decision", "doctor_diagnosis").withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    return fb.apply_reviews(cases, _reviews(spark, d)).select("case_id", "review_status", "doctor_diagnosis")


@query("X4", f"with {_REV} select review_id, case when decision = 'maybe' then 'unknown decision' else 'rejected without correction' end as reason from rv where decision = 'maybe' or (decision = 'rejected' and dx = '')")
def rejected_reviews(spark, d):
    return fb.split_reviews(_reviews(spark, d))[1].select("review_id", "reason")


@query("D1 P14", f"with {CASES_REVIEW_SQL} select case_id, review_status from review")
def all_cases(spark, d):
    c = adapters.review_cases(spark, d).select("case_id", "review_status")
    return fb.with_status(c, "pending").unionByName(fb.with_status(c, "reviewed"))


# ---- profiles ----------------------------------------------------------------------------------


def _updates(spark, d):
    """Events as session updates of a person."""
    e = F.col("event_id")
    item = lambda n, det: F.struct(n.alias("name"), det.alias("detail"))
    none = F.expr("cast(array() as array<struct<name:string,detail:string>>)")
    empty = F.expr("cast(map() as map<string,string>)")
    return read_table(spark, d, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("patient"), e.alias("ord"), F.col("ts").alias("session_ts"),
        F.create_map(F.lit("age"), F.when(e % 4 == 0, (e % 90).cast("string")).otherwise(""), F.lit("gender"), F.when(e % 5 == 0, "f").otherwise("")).alias("demographics"),
        F.when(e % 10 == 0, F.array(item(F.concat(F.lit("c"), (e % 7).cast("string")), F.when(e % 20 == 0, "2020").otherwise("")))).otherwise(none).alias("known_conditions"),
        F.when(e % 15 == 0, F.array(item(F.lit("m1"), F.lit("pain")), item(F.lit("m2"), F.lit("")))).otherwise(none).alias("medications"),
        F.when(e % 25 == 0, F.array(item(F.lit("nuts"), F.lit("")))).otherwise(none).alias("allergies"),
        none.alias("family_history"), none.alias("surgical_history"),
        F.when(e % 6 == 0, F.create_map(F.lit("status"), F.lit("former"), F.lit("quit"), (e % 30 + 1990).cast("string"))).otherwise(empty).alias("smoking_history"),
        empty.alias("substance_use"),
        F.array("event_type").alias("symptoms"), F.lit("routine").alias("urgency"),
        F.when(e % 3 == 0, F.concat(F.lit("dx"), (e % 8).cast("string"))).otherwise("").alias("diagnosis"), F.lit("").alias("summary"),
    )


_UPD = """upd as (select 'p' || user_id as patient, event_id as e, ts, event_type from events),
sc as (select patient, arg_min((e % 90)::varchar, e) filter (where e % 4 = 0) as age, arg_min('f', e) filter (where e % 5 = 0) as gender,
  max(e) filter (where e % 6 = 0) as smoke, count(*) as sessions, max(ts) as last_updated from upd group by patient)"""


@query("X3 H56", f"with {_UPD} select patient, age, gender, 'quit ' || (smoke % 30 + 1990) as quit, sessions, last_updated from sc")
def profile_fold(spark, d):
    s = pf.fold_scalars(_updates(spark, d))
    return s.select("patient", "age", "gender", F.concat(F.lit("quit "), F.col("smoking_history")["quit"]).alias("quit"), "sessions", "last_updated")


@query(
    "X3",
    """select 'p' || user_id as patient, 'known_conditions' as field, event_id as ord, 'c' || (event_id % 7) as name from events where event_id % 10 = 0
       union all select 'p' || user_id, 'medications', event_id, m from events, (values ('m1'), ('m2')) t(m) where event_id % 15 = 0
       union all select 'p' || user_id, 'allergies', event_id, 'nuts' from events where event_id % 25 = 0""",
)
def profile_items(spark, d):
    return pf.fold_items(_updates(spark, d)).select("patient", "field", "ord", "name")


@query("W16 X3", "select 'p' || user_id as patient, event_id as ord, row_number() over (partition by user_id order by event_id) as session_number from events")
def session_numbers(spark, d):
    return pf.session_entries(_updates(spark, d)).select("patient", "ord", "session_number")


_CTX = f"""{_UPD},
it0 as (select patient, 'known_conditions' as field, e, 0 as pos, 'c' || (e % 7) as name, case when e % 20 = 0 then ' (since 2020)' else '' end as since, '' as purpose from upd where e % 10 = 0
  union all select patient, 'medications', e, k, 'm' || (k + 1), '', case when k = 0 then ' (for pain)' else '' end from upd, (values (0), (1)) t(k) where e % 15 = 0
  union all select patient, 'allergies', e, 0, 'nuts', '', '' from upd where e % 25 = 0),
it as (select *, (row_number() over (partition by patient, field order by e, pos) - 1) // 200 as part from it0),
pc as (select patient, field, part, case when part > 0 then ', ' else '' end as sep, string_agg(name || since || purpose, ', ' order by e, pos) as full_,
  string_agg(name || since, ', ' order by e, pos) as semi_, string_agg(name, ', ' order by e, pos) as plain from it group by all),
l3 as (select *, row_number() over (partition by patient order by e desc) as b from upd),
rec as (select patient, string_agg(strftime(ts, '%Y-%m-%d') || ' (' || event_type || ' → ' || case when e % 3 = 0 then 'dx' || (e % 8) else '' end || ' diagnosed)', '; ' order by e) as t,
  string_agg('- Previous diagnosis: dx' || (e % 8) || ' (' || strftime(ts, '%Y-%m-%d') || ')', chr(10) order by e) filter (where e % 3 = 0) as dx from l3 where b <= 3 group by patient),
z as (select sc.patient, sessions, 'former smoker — quit ' || (smoke % 30 + 1990) as smoking, rec.t as rec, rec.dx as dx,
  sc.patient in (select patient from it where field = 'allergies') as has_a, smoke is not null or sc.patient in (select patient from it) as conf from sc left join rec using (patient))"""


@query(
    "H56 W11",
    f"""with {_CTX}, lines as (
      select patient, 0 as line_no, 0 as part, 'Known patient history:' as text from z
      union all select patient, 4, 0, chr(10) || '- Smoking: ' || smoking from z where smoking is not null
      union all select patient, 8, 0, chr(10) || '- Previous sessions: ' || sessions || case when sessions = 1 then ' session — ' else ' sessions — ' end || rec from z
      union all select patient, 9, 0, chr(10) from z
      union all select patient, 10, 0, chr(10) || 'Briefly CONFIRM these known facts with the patient (one sentence each, accept yes/no — if anything changed, record the update):' from z where conf
      union all select patient, 11, 0, chr(10) || '  - smoking history (' || smoking || ')' from z where smoking is not null
      union all select patient, 14, 0, chr(10) || '  - allergies' from z where has_a
      union all select patient, 16, 0, chr(10) from z where conf
      union all select patient, 17, 0, chr(10) || 'Focus your detailed questions on the NEW presenting complaint.' from z
      union all select patient, case field when 'known_conditions' then 1 when 'medications' then 2 else 3 end, part,
        case when part = 0 then chr(10) || '- ' || case field when 'known_conditions' then 'Conditions: ' when 'medications' then 'Medications: ' else 'Allergies: ' end else sep end || full_ from pc
      union all select patient, case field when 'known_conditions' then 12 else 13 end, part,
        case when part = 0 then chr(10) || '  - ' || case field when 'known_conditions' then 'conditions (' else 'medications (' end else sep end || plain from pc where field <> 'allergies'
      union all select distinct patient, case field when 'known_conditions' then 12 else 13 end, 2000000000, ')' from pc where field <> 'allergies')
    select * from lines""",
)
def intake_context(spark, d):
    u = _updates(spark, d)
    return pf.intake_context(pf.fold_scalars(u), pf.fold_items(u), pf.session_entries(u))


@query(
    "H56 W11",
    f"""with {_CTX}, lines as (
      select patient, 0 as line_no, 0 as part, 'Patient history:' as text from z
      union all select patient, 4, 0, chr(10) || '- Smoking: ' || smoking from z where smoking is not null
      union all select patient, 7, 0, chr(10) || dx from z where dx is not null
      union all select patient, 8, 0, chr(10) from z
      union all select patient, 9, 0, chr(10) || 'Consider this history when forming your differential diagnosis.' from z
      union all select patient, case field when 'known_conditions' then 1 when 'medications' then 2 else 3 end, part,
        case when part = 0 then chr(10) || '- ' || case field when 'known_conditions' then 'Known conditions: ' when 'medications' then 'Medications: ' else 'Allergies: ' end else sep end || semi_ from pc)
    select * from lines""",
)
def triage_context(spark, d):
    u = _updates(spark, d)
    return pf.triage_context(pf.fold_scalars(u), pf.fold_items(u), pf.session_entries(u))


# ---- sessions ----------------------------------------------------------------------------------


@query(
    "X1",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as o from events),
    s as (select *, sum(o) over (partition by user_id order by ts rows between unbounded preceding and current row) as n from g)
    select user_id, min(ts) as session_start, max(ts) as last_active, count(*) as events from s group by user_id, n""",
)
def session_ttl(spark, d):
    return ss.expire_sessions(read_table(spark, d, "events"))


@query(
    "W12 X2",
    f"""with {MESSAGES_SQL} select session_id, turn, ['routine','urgent','emergency'][1 + max(list_position(['routine','urgent','emergency'], urgency) - 1) over (partition by session_id order by turn)] as running_urgency from messages""",
)
def monotone_urgency(spark, d):
    return ss.monotone_urgency(adapters.messages(spark, d)).select("session_id", "turn", "running_urgency")


@query(
    "X2",
    f"""with {MESSAGES_SQL} select session_id, ['routine','urgent','emergency'][1 + max(list_position(['routine','urgent','emergency'], urgency) - 1)] as urgency,
      string_agg(distinct message_type, ',' order by message_type) as flags, count(*) filter (where sender = 'user') as answered from messages group by session_id""",
)
def session_state(spark, d):
    m = adapters.messages(spark, d).withColumn("flag", F.col("message_type")).withColumn("answered", F.col("sender") == "user")
    return ss.session_state(m).select("session_id", "urgency", F.array_join("flags", ",").alias("flags"), "answered")


@query(
    "X5",
    f"""with {MESSAGES_SQL}, l as (select *, lag(message_type) over (partition by session_id order by turn) as from_phase from messages)
    select session_id, turn, from_phase, message_type as phase from l where from_phase is null or from_phase <> message_type""",
)
def phase_changes(spark, d):
    m = adapters.messages(spark, d).select("session_id", "turn", F.col("message_type").alias("phase"))
    return ss.phase_changes(m).select("session_id", "turn", "from_phase", "phase")


@query("X6", f"with {MESSAGES_SQL} select session_id, arg_max(message_type, turn) as phase, arg_max(urgency, turn) as urgency, max(turn) as turn from messages group by session_id")
def session_row_updates(spark, d):
    m = adapters.messages(spark, d)
    last = m.groupBy("session_id").agg(F.max_by(F.struct("message_type", "urgency"), "turn").alias("m"), F.max("turn").alias("turn"))
    return last.select("session_id", F.col("m.message_type").alias("phase"), F.col("m.urgency").alias("urgency"), "turn")


@query(
    "D4",
    """with x as (select source, unnest(string_split(text, ' ')) as item, doc_id from documents)
    select source, item, min(doc_id) as first_doc from x where item is not null group by all""",
)
def pooled_distinct(spark, d):
    x = read_table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "item"))
    return ss.pool_distinct(x, "source", "item", ["doc_id", "pos"]).select("source", "item", F.col("first.doc_id").alias("first_doc"))


@query(
    "D5",
    "select user_id, event_type as flag, arg_min(value, event_id) as value, min(event_id) as event_id from events group by all",
)
def pooled_flags(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.col("event_type").alias("flag"), "event_id", "value")
    return first_seen(e, ["user_id", "flag"], ["event_id"])


@query(
    "D7",
    """with ex as (select conv_id as session_id, role as flag, 'routine' as urgency, min(turn) as turn from conversations where turn <= 1 group by all),
    tr as (select conv_id as session_id, case when turn % 3 = 0 then 'late' else role end as flag, turn from conversations where turn > 1)
    select * from ex union all select session_id, flag, 'urgent', min(turn) from tr where (session_id, flag) not in (select session_id, flag from ex) group by session_id, flag""",
)
def new_flags(spark, d):
    c = read_table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    ex = c.filter("turn <= 1").groupBy("session_id", F.col("role").alias("flag")).agg(F.lit("routine").alias("urgency"), F.min("turn").alias("turn"))
    tr = c.filter("turn > 1").select("session_id", F.when(F.col("turn") % 3 == 0, "late").otherwise(F.col("role")).alias("flag"), F.lit("urgent").alias("urgency"), "turn")
    return ss.add_new_flags(ex, tr)
