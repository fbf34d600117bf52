"""Registered queries: privacy, web sources, page text, claims, reviews, decisions, approach comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import privacy, web
from dossier.functions.text import strip
from dossier.operators import evidence, experiments
from dossier.plans.oracle import WS, sentences
from dossier.plans.oracle import strip as o_strip
from dossier.plans.registry import query
from dossier.sources.readers import read_table

YEAR = 2025
# Test stand-ins for the trust policy and the claim words of the test languages.
TIERS = {1: ("example.com",), 2: ("example.org",), 3: ("example.net",)}
CLAIM_WORDS = ("the", "die", "les", "los")


# ---- privacy -----------------------------------------------------------------------------------

def _oracle_pattern(p: str) -> tuple[str, str]:
    flag = "gi" if p.startswith("(?i)") else "g"
    p = p.removeprefix("(?i)")
    inner = WS[1:-1]
    p = p.replace("[-.\\s]", f"[-.{inner}]").replace("[\\w.+-]", "[\\p{L}\\p{N}_.+-]").replace("[\\w-]", "[\\p{L}\\p{N}_-]").replace("[\\w.-]", "[\\p{L}\\p{N}_.-]")
    p = p.replace("\\d", "\\p{Nd}").replace("\\s", WS).replace("'", "''")
    return p, flag


def _redacted(table: str, key: str) -> str:
    steps, prev = [f"r0 as (select {key}, coalesce(text, '') as s0 from {table})"], "s0"
    for i, (_, p) in enumerate(privacy.IDENTIFIERS, start=1):
        pat, flag = _oracle_pattern(p)
        steps.append(f"r{i} as (select *, regexp_replace({prev}, '{pat}', ' ', '{flag}') as s{i} from r{i - 1})")
        prev = f"s{i}"
    kinds = ", ".join(f"case when s{i} <> s{i - 1} then '{k}' end" for i, (k, _) in enumerate(privacy.IDENTIFIERS, start=1))
    clean = o_strip(f"regexp_replace({prev}, '{WS}+', ' ', 'g')")
    steps.append(f"red as (select {key}, {clean} as clean_text, list_filter([{kinds}], lambda k: k is not null) as kinds from r{len(privacy.IDENTIFIERS)})")
    return ",\n".join(steps)


_RED_DOCS = _redacted("documents", "doc_id")


@query(
    "H38",
    f"with {_RED_DOCS} select doc_id, md5(clean_text) as clean_digest, length(clean_text) as n, coalesce(list_aggregate(kinds, 'string_agg', ','), '') as kinds from red",
)
def redact_pii(spark, d):
    r = privacy.redact(read_table(spark, d, "documents").select("doc_id", "text"), "text")
    return r.select("doc_id", F.md5("clean_text").alias("clean_digest"), F.length("clean_text").alias("n"), F.array_join("kinds", ",").alias("kinds"))


@query(
    "H38 D8",
    f"""with {_redacted('conversations', 'conv_id, turn')}
    select conv_id, coalesce(string_agg(distinct k, ',' order by k), '') as kinds, count(distinct turn) as turns
    from (select conv_id, turn, unnest(case when len(kinds) = 0 then [null] else kinds end) as k from red) group by conv_id""",
)
def pii_kinds(spark, d):
    r = privacy.redact(read_table(spark, d, "conversations"), "text").select("conv_id", "turn", F.explode_outer("kinds").alias("k"))
    return r.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set("k")), ",").alias("kinds"), F.count_distinct("turn").alias("turns")
    )


_FEVER = "case when doc_id % 4 = 0 then ['fever', 'call 555 123 4567'] else ['cough'] end"


@query(
    "H39 H40 D8",
    f"""select doc_id,
      case when doc_id % 90 < 1 then 'infant' when doc_id % 90 < 13 then 'child' when doc_id % 90 < 18 then 'adolescent'
           when doc_id % 90 < 40 then 'adult' when doc_id % 90 < 65 then 'middle-aged adult' else 'older adult' end as age_range,
      lower(case when doc_id % 2 = 0 then 'Female' else 'male' end) as sex,
      case when doc_id % 4 = 0 then 'fever,call' else 'cough' end as symptoms,
      case when doc_id % 4 = 0 then 'exact_age,location,phone_number' else 'exact_age,location' end as removed,
      'age_range,sex,symptoms' as kept
      from documents""",
)
def context_sanitise(spark, d):
    e = F.col("doc_id")
    none = F.expr("cast(array() as array<string>)")
    ctx = read_table(spark, d, "documents").select(
        "doc_id",
        F.create_map(
            F.lit("Age"), (e % 90).cast("string"), F.lit("sex"), F.when(e % 2 == 0, "Female").otherwise("male"), F.lit("location"), F.col("source"),
            F.lit("notes"), F.lit(""),
        ).alias("context"),
        F.when(e % 4 == 0, F.array(F.lit("fever"), F.lit("call 555 123 4567"))).otherwise(F.array(F.lit("cough"))).alias("symptoms"),
        none.alias("red_flags"), none.alias("comorbidities"), none.alias("medications"),
    )
    s = privacy.sanitise_context(ctx)
    return s.select(
        "doc_id", F.col("safe")["age_range"].alias("age_range"), F.col("safe")["sex"].alias("sex"),
        F.array_join("safe_symptoms", ",").alias("symptoms"), F.array_join("removed", ",").alias("removed"), F.array_join("kept", ",").alias("kept"),
    )


_TRIG = " or ".join(f"contains(lower(clean_text), '{t}')" for t in privacy.GUIDELINE_TRIGGERS)


@query(
    "H41 H53",
    f"""with {_RED_DOCS}, q as (
      select doc_id, {o_strip(f"regexp_replace(regexp_replace(concat_ws(' ', clean_text, case when {_TRIG} then 'guideline recommendation' end, case when contains(lower(clean_text), 'latest') or contains(lower(clean_text), 'updated') then 'updated' end, 'WHO CDC NICE NIH PubMed'), '[^A-Za-z0-9{WS[1:-1]}\\-]', ' ', 'g'), '{WS}+', ' ', 'g')")} as q
      from red)
    select doc_id, md5(q) as query_digest, not (regexp_matches(q, '\\b[0-9]{{3,4}}[-. ]?[0-9]{{4}}\\b') or regexp_matches(lower(q), '\\b(mrn|hospital id|patient id|national id|ssn)\\b')) as is_private from q""",
)
def search_query(spark, d):
    r = privacy.redact(read_table(spark, d, "documents").select("doc_id", "text"), "text")
    r = r.withColumn("q", privacy.search_string(F.array("clean_text")))
    return r.select("doc_id", F.md5("q").alias("query_digest"), privacy.query_is_private(F.col("q")).alias("is_private"))


@query(
    "H53",
    """select conv_id, turn, (case when regexp_matches(lower(text), '\\btake\\s+[0-9]+\\s*(mg|mcg|g)\\b') or regexp_matches(lower(text), '\\b(stop taking|start taking|double your dose)\\b') then 0.5::double else 0.0::double end)
       + (case when contains(lower(text), 'physician review') or contains(lower(text), 'clinician judgment') or contains(lower(text), 'doctor') then 0.0::double else 0.25::double end) as penalty
       from conversations""",
)
def privacy_and_safety_penalty(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", privacy.safety_penalty(F.col("text")).alias("penalty"))


# ---- pages and sources -------------------------------------------------------------------------

_HOST = "regexp_replace(lower(case when contains(url, '://') then regexp_extract(url, '://([^/?#]*)', 1) else url end), '^www\\.', '')"


def _under(x: str, dom: str) -> str:
    return f"({x} = '{dom}' or ends_with({x}, '.{dom}'))"


_TIER = f"(case when {_under('host', 'example.com')} then 1 when {_under('host', 'example.org')} then 2 when {_under('host', 'example.net')} then 3 else 99 end)"


def _page_text_sql(x: str, tags) -> str:
    for t in web.DROP_TAGS:
        x = f"regexp_replace({x}, '<{t}(\\s[^>]*)?>.*?</{t}\\s*>', ' ', 'gis')"
    names = "|".join(tags)
    x = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    x = f"regexp_replace({x}, '<({names})(\\s[^>]*)?>', chr(1), 'gi')"
    x = f"regexp_replace({x}, '</({names})\\s*>', chr(2), 'gi')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'gs')"
    un = "string_split(b, chr(2))[1]"
    for ref, ch in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        un = f"replace({un}, '{ref}', '{ch}')"
    lst = f"list_filter(list_transform(string_split({x}, chr(1))[2:], lambda b: {o_strip(un)}), lambda b: b <> '')"
    return o_strip(f"regexp_replace(coalesce(list_aggregate({lst}, 'string_agg', ' '), ''), '{WS}+', ' ', 'g')")


def _title_sql(x: str) -> str:
    un = f"regexp_extract({x}, '<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1, 'is')"
    for ref, ch in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        un = f"replace({un}, '{ref}', '{ch}')"
    return o_strip(un)


@query(
    "H32 J16 H33 P11",
    f"""with h as (select page_id, {_HOST} as host from pages)
    select page_id, host, {_TIER} as tier, contains(host, 'blog') or contains(host, 'forum') or contains(host, 'substack') or contains(host, 'medium.com') as rejected,
      {_under('host', 'example.com')} or {_under('host', 'm.example.org')} as allowed from h""",
)
def page_host(spark, d):
    p = read_table(spark, d, "pages").select("page_id", web.host(F.col("url")).alias("host"))
    return p.select(
        "page_id", "host", web.source_tier(F.col("host"), TIERS).alias("tier"), web.is_rejected(F.col("host")).alias("rejected"),
        web.under_any(F.col("host"), ("example.com", "m.example.org")).alias("allowed"),
    )


@query("J16", f"with h as (select page_id, {_HOST} as host from pages) select page_id, {_TIER} as source_tier from h")
def source_tier(spark, d):
    policy = spark.createDataFrame([(dom, t) for t, doms in TIERS.items() for dom in doms], "domain string, tier int")
    p = read_table(spark, d, "pages").select("page_id", web.host(F.col("url")).alias("domain"))
    return evidence.tier_by_policy(p, policy).select("page_id", "source_tier")


@query(
    "H42 S16",
    f"select page_id, length(t) as n, md5(left(t, 16000)) as digest, left(t, 500) as snippet from (select page_id, {_page_text_sql('html', web.TEXT_TAGS)} as t from pages)",
)
def page_text(spark, d):
    p = read_table(spark, d, "pages").select("page_id", web.page_text(F.col("html")).alias("t"))
    return p.select(
        "page_id", F.length("t").alias("n"), F.md5(F.substring("t", 1, web.PAGE_CHARS)).alias("digest"), F.substring("t", 1, web.SNIPPET_CHARS).alias("snippet")
    )


@query(
    "H43",
    f"select page_id, md5(left(t, 2000)) as digest from (select page_id, {_page_text_sql('html', web.SHORT_TEXT_TAGS)} as t from pages)",
)
def page_text_short(spark, d):
    p = read_table(spark, d, "pages").select("page_id", web.page_text(F.col("html"), web.SHORT_TEXT_TAGS).alias("t"))
    return p.select("page_id", F.md5(F.substring("t", 1, web.SHORT_PAGE_CHARS)).alias("digest"))


@query("H42")
def page_text_nested(spark, d):
    """Nested-markup form; SQL has no parser for it, so the test suite checks it on fixtures."""
    p = read_table(spark, d, "pages").select("page_id", web.nested_page_text()(F.col("html")).alias("t"))
    return p.select("page_id", F.substring("t", 1, web.PAGE_CHARS).alias("text"), F.substring("t", 1, web.SNIPPET_CHARS).alias("snippet"))


# The pages carry no dates: every way to write one is put into their heads, by page_id.
_DATED = (
    "",
    '<meta name="date" content="2021-03-04T05:06">',
    '<meta name="last-modified" content="2015-01-02"><meta property="article:published_time" content="2020-10-11T00:00:00Z">',
    '<time datetime="2019-12-31T10:00">last year</time>',
    "<META content='2018-07-08' name='dc.date'>",
    "<time><b>May 2013</b>, 5th</time>",
    '<!-- <meta name="date" content="1999-01-01"> --><meta name=dc.date.issued content="2012-02-03">',
    '<meta property="date" content=""><meta name="date" content="2001-01-01"><meta name="dc.date" content="2002-02-02">',
)


def _attribute_sql(tag: str, name: str) -> str:
    pattern = f"""(?is)[\\s"'']{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))"""
    return " || ".join(f"regexp_extract({tag}, '{pattern}', {g})" for g in (1, 2, 3))


def _date_sql() -> str:
    heads = " ".join(f"when {i} then '{h.replace(chr(39), chr(39) * 2)}'" for i, h in enumerate(_DATED))
    first = lambda field, name: f"list_filter(metas, lambda m: m.{field} = '{name}')"
    choice = ", ".join(f"nullif(case when len({first('p', n)}) > 0 then {first('p', n)}[1].c when len({first('n', n)}) > 0 then {first('n', n)}[1].c end, '')" for n in web.DATE_NAMES)
    time = "(?is)<time(\\s[^>]*)?>(.*?)(?:</time\\s*>|$)"
    return f"""dated as (select page_id, html, regexp_replace(replace(html, '<head>', '<head>' || case page_id % {len(_DATED)} {heads} end), '(?s)<!--.*?-->', '', 'g') as bare from pages),
    tagged as (select page_id, html, bare, list_transform(regexp_extract_all(bare, '(?is)<meta\\s[^>]*>'), lambda t: {{'p': {_attribute_sql('t', 'property')}, 'n': {_attribute_sql('t', 'name')}, 'c': {_attribute_sql('t', 'content')}}}) as metas,
      regexp_extract(bare, '{time}', 1) as time_tag, {o_strip(f"regexp_replace(regexp_extract(bare, '{time}', 2), '{WS}*<[^>]*>{WS}*', ' ', 'g')")} as time_text from dated),
    chosen as (select page_id, html, left(coalesce({choice}, nullif({_attribute_sql('time_tag', 'datetime')}, ''), nullif(time_text, '')), 10) as published from tagged)"""


@query("H42 H44", f"with {_date_sql()} select page_id, {_title_sql('html')} as title, published from chosen")
def page_title_date(spark, d):
    heads = F.array(*[F.lit(h) for h in _DATED])
    head = F.concat(F.lit("<head>"), F.get(heads, (F.col("page_id") % len(_DATED)).cast("int")))
    p = read_table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<head>"), head).alias("html"))
    return p.select("page_id", web.page_title(F.col("html")).alias("title"), web.page_date(F.col("html")).alias("published"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    lang = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    return read_table(spark, d, "pages").select(lang.alias("request_id")).distinct()


def _question(col):
    return F.concat(F.lit("latest recommendations that the ation "), col)


def _results(spark: SparkSession, d: str) -> DataFrame:
    text = web.page_text(F.col("html"))
    p = F.col("page_id")
    return read_table(spark, d, "pages").select(
        F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("request_id"),
        p.alias("seq"),
        "url",
        web.host(F.col("url")).alias("domain"),
        web.page_title(F.col("html")).alias("title"),
        F.substring(text, 1, web.SNIPPET_CHARS).alias("snippet"),
        text.alias("text"),
        F.when(p % 4 == 1, "2024-03-01").when(p % 4 == 2, "Updated May 2013").when(p % 4 == 3, "2018").alias("date"),
    ).withColumn("query", _question(F.col("request_id")))


_RESULTS = f"""res as (
  select page_id as seq, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) as request_id, url, {_HOST} as host, {_title_sql('html')} as title,
         {_page_text_sql('html', web.TEXT_TAGS)} as text,
         case page_id % 4 when 1 then '2024-03-01' when 2 then 'Updated May 2013' when 3 then '2018' end as date,
         case page_id % 4 when 1 then 2024 when 2 then 2013 when 3 then 2018 end as year from pages),
res1 as (select *, left(text, 500) as snippet, {_TIER} as tier,
   contains(host, 'blog') or contains(host, 'forum') or contains(host, 'substack') or contains(host, 'medium.com') as rejected from res),
res2 as (select *, lower(concat_ws(' ', title, snippet, host)) as hay, lower(concat_ws(' ', title, snippet)) as ts,
   list_distinct(['latest','recommendations','that','the','ation'] || list_filter([request_id], lambda t: length(t) > 2)) as terms from res1),
res3 as (select *, case
   {chr(10).join(f"when {' or '.join(f'contains(hay, {chr(39)}{k}{chr(39)})' for k in ks)} then '{n}'" for n, ks in web.TYPE_KEYWORDS.items())}
   when tier = 1 then 'government' else 'unknown' end as kind,
   len(list_filter(terms, lambda t: contains(ts, t)))::double / len(terms) * 0.12::double as rel from res2),
scored as (select *, round(greatest(0.0::double, least(1.0::double, case when rejected then 0.0::double else
   (case tier when 1 then 0.95::double when 2 then 0.82::double when 3 then 0.65::double else 0.35::double end)
   + (case kind when 'guideline' then 0.08::double when 'government' then 0.06::double else 0.0::double end)
   + (case when year is null then -0.04::double when {YEAR} - year <= 5 then 0.05::double when {YEAR} - year >= 10 then -0.12::double else 0.0::double end)
   + rel end)), 3) as score from res3),
ranked as (select *, row_number() over (partition by request_id order by score desc, seq) as source_rank from scored where url <> '')"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evidence.score_sources(_results(spark, d), YEAR, tier=web.source_tier(F.col("domain"), TIERS))


@query(
    "H34 H35 H36 H37",
    f"with {_RESULTS} select seq, tier as source_tier, kind as source_type, rejected as is_rejected, year, score as reliability_score from ranked",
)
def source_scores(spark, d):
    return _scored(spark, d).select("seq", "source_tier", "source_type", "is_rejected", "year", "reliability_score")


@query("T4 P19 P18", f"with {_RESULTS} select request_id, seq, url, source_rank, score as reliability_score from ranked where source_rank <= 5")
def source_score_topk(spark, d):
    return evidence.top_sources(_scored(spark, d).drop("text")).select("request_id", "seq", "url", "source_rank", "reliability_score")


@query("J21", f"with {_RESULTS} select request_id, seq from res semi join (select distinct request_id, url from ranked where source_rank <= 10) k using (request_id, url)")
def candidate_restriction(spark, d):
    r = _results(spark, d)
    return evidence.candidates(r, _scored(spark, d)).select("request_id", "seq")


_CLAIMS = f"""{_RESULTS},
sents as (select request_id, source_rank, url, tier, {sentences('text', False)} as ss from ranked where source_rank <= 5),
c0 as (select request_id, source_rank, url, tier, unnest(ss) as raw, unnest(range(len(ss))) as pos from sents),
c1 as (select *, {o_strip(f"regexp_replace(raw, '{WS}+', ' ', 'g')")} as claim from c0),
c2 as (select * from c1 where length(claim) >= 40 and ({' or '.join(f"contains(lower(claim), '{w}')" for w in CLAIM_WORDS)})),
c3 as (select *, row_number() over (partition by request_id, lower(claim) order by source_rank, pos) as dup from c2),
claims as (select request_id, source_rank, url, left(claim, 500) as claim, case tier when 1 then 'high' when 2 then 'moderate' else 'low' end as confidence,
   row_number() over (partition by request_id order by source_rank, pos) as claim_no from c3 where dup = 1)"""


def _claims(spark: SparkSession, d: str, sources: DataFrame) -> DataFrame:
    return evidence.extract_claims(sources, CLAIM_WORDS)


@query("H45 D6 T13", f"with {_CLAIMS} select request_id, claim_no, source_rank, url, claim, confidence from claims where claim_no <= 8")
def claims(spark, d):
    return _claims(spark, d, evidence.top_sources(_scored(spark, d)))


_UNSAFE = "regexp_matches(lower({x}), '\\btake\\s+[0-9]+\\s*(mg|mcg|g)\\b') or regexp_matches(lower({x}), '\\b(stop taking|start taking|double your dose)\\b')"

_REVIEWS = f"""{_CLAIMS},
src as (select request_id, count(*) as n_sources, count(*) filter (where tier = 1) as tier_1, count(*) filter (where tier = 2) as tier_2,
   count(*) filter (where rejected) as n_rejected, string_agg(host, ',' order by source_rank) filter (where rejected) as rejected_domains,
   count(*) filter (where {YEAR} - year <= 5) as n_recent, count(*) filter (where year is null) as n_missing, count(*) filter (where {YEAR} - year >= 10) as n_old,
   list(title || ' (' || host || coalesce(', updated/published ' || date, '') || ')' order by source_rank) as phrases
   from ranked where source_rank <= 5 group by request_id),
cl as (select request_id, list(claim order by claim_no) as claims from claims where claim_no <= 8 group by request_id),
j as (select s.*, coalesce(c.claims, []) as claims, lower(coalesce(list_aggregate(c.claims, 'string_agg', ' '), '')) as ctext,
   'latest recommendations that the ation ' || s.request_id as question from src s left join cl c on c.request_id = s.request_id),
dec as (select *,
   case when tier_1 + tier_2 = 0 then 'reject' when n_rejected > 0 and n_rejected = n_sources then 'reject' when tier_1 > 0 then 'accept' else 'accept_with_caution' end as source_decision,
   case when n_old > 0 then 'accept_with_caution' when n_missing > 0 and n_recent = 0 then 'accept_with_caution' else 'accept' end as recency_decision,
   list_filter([case when contains(ctext, 'recommend') and contains(ctext, 'not recommend') then '{evidence.CONFLICT_BOTH}' end,
     case when contains(ctext, 'first-line') and contains(ctext, 'avoid') then '{evidence.CONFLICT_AVOID}' end,
     case when contains(ctext, 'contraindicated') and contains(ctext, 'should') then '{evidence.CONFLICT_CONTRA}' end], lambda x: x is not null) as conflicts,
   case when {_UNSAFE.format(x="ctext || ' ' || question")} then 'reject' when len(claims) = 0 then 'accept_with_caution' else 'accept' end as safety_decision from j),
fin as (select *, case when source_decision = 'reject' or safety_decision = 'reject' then 'reject' else 'accept_with_caution' end as final_decision,
   (case when len(claims) > 0 then 'For physician review, guideline-level sources suggest the following preliminary evidence for: ' || question || '. ' || list_aggregate(claims[1:3], 'string_agg', ' ')
      else 'For physician review, reliable sources were identified for: ' || question || ', but deterministic extraction did not produce a strong claim.' end)
   || (case when len(conflicts) > 0 then ' Potential conflict noted: ' || list_aggregate(conflicts, 'string_agg', '; ') || '.' else '' end)
   || ' Key reviewed sources: ' || list_aggregate(phrases[1:3], 'string_agg', '; ') || '.'
   || ' This is not a final diagnosis or direct patient treatment instruction; it requires clinician judgment.' as summary from dec)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    top = evidence.top_sources(_scored(spark, d))
    reqs = _requests(spark, d).select(
        "request_id", _question(F.col("request_id")).alias("question"), F.lit(True).alias("deidentified"),
        F.expr("cast(array() as array<string>)").alias("limitations"),
    )
    return evidence.review_requests(reqs, top, _claims(spark, d, top), YEAR)


@query(
    "H46 H47 H48 H49 H50 H51 A27",
    f"""with {_REVIEWS} select request_id, n_sources, tier_1, tier_2, n_rejected, coalesce(rejected_domains, '') as rejected_domains, n_recent, n_missing, n_old,
      source_decision, recency_decision, safety_decision, len(conflicts) as n_conflicts, final_decision from fin""",
)
def council_decision(spark, d):
    r = _reviewed(spark, d)
    return r.select(
        "request_id", "n_sources", "tier_1", "tier_2", "n_rejected", F.array_join("rejected_domains", ",").alias("rejected_domains"),
        F.size("recent_sources").alias("n_recent"), F.size("missing_dates").alias("n_missing"), F.size("old_sources").alias("n_old"),
        "source_decision", "recency_decision", "safety_decision", F.size("conflicts").alias("n_conflicts"), "final_decision",
    )


def _scored_sql(source: str, out: str) -> str:
    """CTEs that rate a table (request_id, seq, url, host, title, snippet, text, date) and rank the rows with a url."""
    return f"""{out}0 as (select *, try_cast(nullif(regexp_extract(coalesce(date, ''), '\\b(20[0-9]{{2}}|19[0-9]{{2}})\\b', 1), '') as int) as year, {_TIER} as tier,
   contains(host, 'blog') or contains(host, 'forum') or contains(host, 'substack') or contains(host, 'medium.com') as rejected,
   lower(concat_ws(' ', title, snippet, host)) as hay, lower(concat_ws(' ', title, snippet)) as ts,
   list_distinct(['latest','recommendations','that','the','ation'] || list_filter([request_id], lambda t: length(t) > 2)) as terms from {source}),
{out}1 as (select *, case
   {chr(10).join(f"when {' or '.join(f'contains(hay, {chr(39)}{k}{chr(39)})' for k in ks)} then '{n}'" for n, ks in web.TYPE_KEYWORDS.items())}
   when tier = 1 then 'government' else 'unknown' end as kind,
   len(list_filter(terms, lambda t: contains(ts, t)))::double / len(terms) * 0.12::double as rel from {out}0),
{out}2 as (select *, round(greatest(0.0::double, least(1.0::double, case when rejected then 0.0::double else
   (case tier when 1 then 0.95::double when 2 then 0.82::double when 3 then 0.65::double else 0.35::double end)
   + (case kind when 'guideline' then 0.08::double when 'government' then 0.06::double else 0.0::double end)
   + (case when year is null then -0.04::double when {YEAR} - year <= 5 then 0.05::double when {YEAR} - year >= 10 then -0.12::double else 0.0::double end)
   + rel end)), 3) as score from {out}1),
{out} as (select *, row_number() over (partition by request_id order by score desc, seq) as source_rank from {out}2 where url <> '')"""


_FLOW = f"""raw as (select page_id as seq, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) as request_id, url, {_HOST} as host, {_title_sql('html')} as title,
     {_page_text_sql('html', web.TEXT_TAGS)} as body from pages),
found as (select request_id, seq, url, host, title, left(body, 160) as snippet, left(body, 160) as text, null::varchar as date, body,
     case when seq % 31 = 0 then 'search_error: ' || seq end as error from raw),
{_scored_sql('found', 'sought')},
picked as (select * from (select *, row_number() over (partition by request_id order by seq) as n from found
     where (request_id, url) in (select (request_id, url) from sought where source_rank <= 10)) where n <= 10),
read as (select request_id, seq, url, host, title, seq % 7 <> 0 as there, seq % 5 = 0 as failed, snippet as old, body from picked),
merged as (select request_id, seq, url, host, title, case when there and not failed then body else old end as text,
     case when there and not failed then left(body, 500) else old end as snippet,
     case when there and not failed then case seq % 4 when 1 then '2024-03-01' when 2 then 'Updated May 2013' when 3 then '2018' end end as date,
     case when there and failed then 'fetch_error: ' || seq end as error from read),
{_scored_sql('merged', 'ranked')},
limits as (select request_id, error, row_number() over (partition by request_id order by step, seq, error) as n
     from (select request_id, 1 as step, seq, error from found where error is not null union all select request_id, 2, seq, error from merged where error is not null)),
said as (select request_id, count(*) as n_limits, string_agg(error, '; ' order by n) filter (where n <= 3) as limitations from limits group by request_id)
{_REVIEWS[len(_RESULTS):]}"""


@query(
    "P19 J21 A27 H46 H51 H52 T4",
    f"""with {_FLOW}, seqs as (select request_id, string_agg(seq::varchar, ',' order by source_rank) as sources from ranked where source_rank <= 5 group by request_id)
    select f.request_id, sources, n_sources, coalesce(n_limits, 0) as n_limitations, coalesce(limitations, '') as limitations, source_decision, recency_decision, safety_decision, final_decision,
      md5(case when limitations is null then summary else replace(summary, ' Key reviewed sources: ', ' Limitations: ' || limitations || '. Key reviewed sources: ') end) as digest
    from fin f join seqs using (request_id) left join said using (request_id)""",
)
def evidence_flow(spark, d):
    """Search results with short snippets; most pages can be read, every fifth fails, every seventh was never fetched."""
    p = _results(spark, d).withColumn("body", F.col("text"))
    seq = F.col("seq")
    lead = F.substring("body", 1, 160)
    results = p.select(
        "request_id", "seq", "url", F.when(seq % 3 == 0, "").when(seq % 3 == 1, F.upper("domain")).otherwise(F.col("domain")).alias("domain"), "title",
        lead.alias("snippet"), F.lit(None).cast("string").alias("date"), "query", F.when(seq % 31 == 0, F.concat(F.lit("search_error: "), seq.cast("string"))).alias("error"),
    )
    fetched = p.filter(seq % 7 != 0).select(
        "request_id", "url", "title", F.col("body").alias("text"), "snippet", "date", F.when(seq % 5 == 0, F.concat(F.lit("fetch_error: "), seq.cast("string"))).alias("error")
    )
    reqs = _requests(spark, d).select("request_id", _question(F.col("request_id")).alias("question"), F.lit(True).alias("deidentified"))
    flow = evidence.evidence_flow(reqs, results, fetched, YEAR, web.source_tier(F.col("domain"), TIERS), CLAIM_WORDS)
    count = flow.limitations.groupBy("request_id").agg(F.count("*").alias("n_limitations"))
    kept = flow.sources.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "seq"))), lambda s: s["seq"].cast("string")).alias("sources"))
    return flow.reviewed.join(kept, "request_id").join(count, "request_id", "left").select(
        "request_id", F.array_join("sources", ",").alias("sources"), "n_sources", F.coalesce("n_limitations", F.lit(0).cast("long")).alias("n_limitations"),
        F.array_join("limitations", "; ").alias("limitations"), "source_decision", "recency_decision", "safety_decision", "final_decision", F.md5("summary").alias("digest"),
    )


@query("H52", f"with {_REVIEWS} select request_id, summary from fin")
def evidence_summary(spark, d):
    return _reviewed(spark, d).select("request_id", "summary")


@query(
    "H65",
    f"""with {_RESULTS} select request_id, string_agg('[Source ' || source_rank || '] ' || title || chr(10) || 'URL: ' || url || chr(10)
        || coalesce(nullif(text, ''), nullif(snippet, ''), '(no content fetched)'), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by source_rank) as block
      from ranked where source_rank <= 5 group by request_id""",
)
def source_blocks(spark, d):
    from dossier.functions.narrative import source_block

    t = evidence.top_sources(_scored(spark, d))
    b = source_block(F.col("source_rank"), F.col("title"), F.col("url"), F.col("text"), F.col("snippet"))
    rows = F.array_sort(F.collect_list(F.struct("source_rank", b.alias("b"))))
    return t.groupBy("request_id").agg(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n---\n\n").alias("block"))


_TOK = f"list_distinct(list_filter(regexp_split_to_array(lower({{x}}), '{WS}+'), lambda t: t <> ''))"


@query(
    "T5",
    f"""with e as (select page_id as entry, lower({_title_sql('html')} || ' ' || url) as hay from pages),
    q as (select item_id as request_id, unnest({_TOK.format(x='text')}) as term from benchmark),
    s as (select q.request_id, e.entry, count(*) filter (where contains(e.hay, q.term)) as score from q, e group by all),
    r as (select *, row_number() over (partition by request_id order by score desc, entry) as rank from s)
    select request_id, entry, score, rank from r where rank <= 5""",
)
def catalogue_rank(spark, d):
    entries = read_table(spark, d, "pages").select(
        F.col("page_id").alias("entry"), F.col("page_id").alias("seq"), web.page_title(F.col("html")).alias("title"), F.col("url").alias("snippet")
    )
    reqs = read_table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))
    return evidence.rank_catalogue(reqs, entries, 5).select("request_id", "entry", "score", "rank")


# ---- approach comparison -----------------------------------------------------------------------

def _approach_results(spark: SparkSession, d: str) -> DataFrame:
    """Events as approach results: event type order picks the approach through its tie-break position."""
    e = F.col("event_id")
    names = F.array(*[F.lit(a) for a in experiments.TIE_BREAK_ORDER])
    hosts = F.array(*[F.lit(h) for h in ("cdc.gov", "bmj.com", "mayoclinic.org", "blog.site.net")])
    tiers = F.array(*[F.lit(t) for t in (1, 2, 3, 99)])

    def src(k):
        i = ((e + k) % 4 + 1).cast("int")
        return F.struct(F.element_at(tiers, i).alias("source_tier"), F.element_at(hosts, i).alias("domain"))

    def claim(k):
        sup = F.when((e + k) % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("u")))
        return F.struct(F.lit("c").alias("claim"), sup.alias("supporting_sources"))

    decisions = F.array(F.lit("accept"), F.lit("accept_with_caution"), F.lit("reject"))
    return read_table(spark, d, "events").select(
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("approach"),
        (e % 50 != 0).alias("valid_json"),
        F.col("value").alias("latency_seconds"),
        F.element_at(decisions, (e % 3 + 1).cast("int")).alias("final_decision"),
        F.when(e % 9 == 0, "reject").otherwise("accept").alias("safety_decision"),
        F.when(e % 8 == 0, "stop taking it").when(e % 8 < 6, "for physician review").otherwise("plain").alias("summary"),
        F.when(e % 10 == 0, "mail a.b@c.org").otherwise("guideline for adults").alias("sanitized_query"),
        (e % 100 != 1).alias("deidentified"),
        F.when(e % 6 == 0, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")).alias("conflicts"),
        F.slice(F.array(src(0), src(1), src(2), src(3)), 1, (e % 5).cast("int")).alias("sources"),
        F.slice(F.array(*[claim(k) for k in range(6)]), 1, (e % 7).cast("int")).alias("claims"),
        F.when(e % 20 == 0, 1).otherwise(0).alias("llm_failure_count"),
        F.when(e % 15 == 0, 2).otherwise(0).alias("deterministic_fallback_count"),
    )


_N = "total"
_APPROACH = f"""raw as (
  select [{', '.join(f"'{a}'" for a in experiments.TIE_BREAK_ORDER)}][user_id % 5 + 1] as approach, event_id as e, value as lat, event_id % 50 <> 0 as ok,
    ['accept','accept_with_caution','reject'][event_id % 3 + 1] as decision, event_id % 9 = 0 as srej,
    case when event_id % 8 = 0 then 0.75::double when event_id % 8 < 6 then 0.0::double else 0.25::double end as penalty,
    event_id % 10 <> 0 and event_id % 100 <> 1 as private, event_id % 6 = 0 as conflict,
    (event_id % 5) as ns, (event_id % 7) as nc,
    (select count(*) from unnest(range(event_id % 5)) t(k) where (event_id + k) % 4 = 0) as t1,
    (select count(*) from unnest(range(event_id % 5)) t(k) where (event_id + k) % 4 = 1) as t2,
    (select count(*) from unnest(range(event_id % 5)) t(k) where (event_id + k) % 4 = 3) as leaks,
    (select count(*) from unnest(range(event_id % 7)) t(k) where (event_id + k) % 3 <> 0) as supported,
    case when event_id % 20 = 0 then 1 else 0 end as fail, case when event_id % 15 = 0 then 2 else 0 end as fb from events),
g as (select approach, count(*) as total, sum(ok::int) as valid, round(avg(lat), 4) as average_latency_seconds,
   count(*) filter (where ok and decision = 'accept') as accepted_count, count(*) filter (where ok and decision = 'accept_with_caution') as accept_with_caution_count,
   count(*) filter (where ok and decision = 'reject') as rejected_count,
   sum(ns) filter (where ok) as ns, sum(t1) filter (where ok) as t1, sum(t2) filter (where ok) as t2, sum(leaks) filter (where ok) as leaks,
   sum(nc) filter (where ok) as nc, sum(supported) filter (where ok) as supported, count(*) filter (where ok and conflict) as conflict,
   count(*) filter (where ok and private) as private, count(*) filter (where ok and (srej or penalty > 0)) as warning,
   avg(penalty) filter (where ok) as mp, sum(fail) filter (where ok) as fails, sum(fb) filter (where ok) as fbs from raw group by approach),
h as (select *, (t1 * 1.0::double + t2 * 0.8::double + (ns - t1 - t2) * 0.35::double) / ns as q_,
   least(nc::double / total / 4, 1.0::double) * 0.65::double + supported::double / greatest(nc, 1) * 0.35::double as c_,
   case when warning > 0 then greatest(0.0::double, (1.0::double - mp) - least(0.35::double, warning::double / total * 0.2::double)) else 1.0::double - mp end as s_,
   private::double / total as p_ from g),
board as (select approach, total as total_queries, accepted_count, accept_with_caution_count, rejected_count,
   round(valid::double / total * 100, 4) as valid_json_rate, round(private::double / total * 100, 4) as privacy_pass_rate,
   round(ns::double / total, 4) as average_sources_per_query, round(t1::double / ns * 100, 4) as tier1_source_percentage,
   round(t2::double / ns * 100, 4) as tier2_source_percentage, leaks::bigint as rejected_domain_leak_count, round(nc::double / total, 4) as average_claims_per_query,
   conflict as conflict_detection_count, warning as safety_warning_count, average_latency_seconds, fails::bigint as llm_failure_count, fbs::bigint as deterministic_fallback_count,
   round(q_, 4) as source_quality_score, round(c_, 4) as evidence_completeness_score, round(s_, 4) as safety_score, round(p_, 4) as privacy_score,
   round(q_ * 0.30::double + c_ * 0.25::double + s_ * 0.25::double + p_ * 0.20::double, 4) as overall_score from h)"""


@query("A22 A23 U5 S10", f"with {_APPROACH} select * from board")
def approach_scores(spark, d):
    return experiments.ordered_table(experiments.approach_metrics(_approach_results(spark, d)))


@query(
    "A24",
    f"""with {_APPROACH} select approach as recommended_approach, overall_score from board
      order by overall_score desc, list_position([{', '.join(f"'{a}'" for a in experiments.TIE_BREAK_ORDER)}], approach) limit 1""",
)
def best_approach(spark, d):
    return experiments.recommended(experiments.approach_metrics(_approach_results(spark, d)))


@query(
    "U5",
    """with a(approach, use_claims) as (values ('deterministic_only', false), ('llm_synthesis_only', false), ('llm_claims_and_synthesis', true), ('full_llm_council', true), ('hybrid_recommended', true))
    select item_id, approach, md5(case when use_claims and item_id % 3 <> 0 then text else 'd: ' || text end) as claims from benchmark, a""",
)
def approach_runs(spark, d):
    b = experiments.per_approach(read_table(spark, d, "benchmark"))
    supplied = F.when(F.col("item_id") % 3 != 0, F.col("text"))
    return b.select("item_id", "approach", F.md5(experiments.stage_value(F.col("use_claims"), supplied, F.concat(F.lit("d: "), "text"))).alias("claims"))


@query(
    "A31",
    """select user_id, sum((event_id % 4 = 0)::int + event_id % 3)::bigint as llm_failures, sum((event_id % 5 = 0)::int + event_id % 2)::bigint as fallbacks from events group by user_id""",
)
def review_counters(spark, d):
    e = F.col("event_id")
    s = "struct<llm_failure:boolean,deterministic_fallback:boolean,llm_failure_count:int,deterministic_fallback_count:int>"
    det = F.array(
        F.struct((e % 4 == 0).alias("llm_failure"), F.lit(None).cast("boolean").alias("deterministic_fallback"), (e % 3).cast("int").alias("llm_failure_count"), F.lit(None).cast("int").alias("deterministic_fallback_count")).cast(s),
        F.struct(F.lit(None).cast("boolean").alias("llm_failure"), (e % 5 == 0).alias("deterministic_fallback"), F.lit(None).cast("int").alias("llm_failure_count"), (e % 2).cast("int").alias("deterministic_fallback_count")).cast(s),
    )
    rows = read_table(spark, d, "events").select("user_id", *experiments.review_counters(det))
    return rows.groupBy("user_id").agg(F.sum("llm_failure_count").alias("llm_failures"), F.sum("deterministic_fallback_count").alias("fallbacks"))
