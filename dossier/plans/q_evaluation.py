"""Registered queries: benchmark aggregates, order statistics, breakdowns, grids, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import metrics as mt
from dossier.operators.sampling import even_sample
from dossier.plans import adapters
from dossier.plans.adapters import CASES_SQL
from dossier.plans.registry import query
from dossier.sources.readers import read_table

_PCT = """srt as (select model, latency_seconds as v, row_number() over (partition by model order by latency_seconds) - 1 as i,
   count(*) over (partition by model) as n from {src} where latency_seconds is not null),
pct as (select model, round(max(case when i = n // 2 then v end), 3) as median_latency_s,
   round(max(case when i = {p95} then v end), 3) as p95_latency_s from srt group by model)"""
_P95 = "least(floor(n * 0.95::double)::bigint, n - 1)"
_P95_WEB = "case when n >= 20 then floor(n * 0.95::double)::bigint else n - 1 end"


@query(
    "A18",
    f"with {CASES_SQL}, {_PCT.format(src='cases', p95=_P95)} select * from pct",
)
def latency_percentiles(spark, d):
    return mt.latency_percentiles(adapters.case_results(spark, d))


@query(
    "A15 A18",
    f"""with {CASES_SQL}, {_PCT.format(src='cases', p95=_P95)},
    b as (select model, count(*) as num_cases, count(*) filter (where error is null or system_diagnosis is not null) as num_completed,
      count(*) filter (where error is not null and system_diagnosis is null) as num_errors, round(sum(is_correct::int)::double / count(*), 4) as accuracy,
      round(avg(latency_seconds), 3) as mean_latency_s, round(1 - sum(json_adherence::int)::double / count(*), 4) as json_error_rate,
      round(sum(retrieval_recall::int)::double / count(*), 4) as retrieval_hit_rate, sum(tokens_used)::bigint as total_tokens from cases group by model)
    select b.*, p.median_latency_s, p.p95_latency_s from b left join pct p using (model)""",
)
def model_metrics(spark, d):
    return mt.benchmark_metrics(adapters.case_results(spark, d))


_PIPE = f"""{CASES_SQL}, {_PCT.format(src='cases', p95=_P95)},
b as (select model, count(*) as num_cases, count(system_diagnosis) as num_completed, round(sum(is_correct::int)::double / count(*), 4) as pipeline_accuracy,
  round(sum(retrieval_recall::int)::double / count(*), 4) as retrieval_recall, round(avg(retrieval_precision::double), 4) as retrieval_precision,
  round(sum((not retrieval_recall and is_correct)::int)::double / count(*), 4) as retrieval_only_fail_rate,
  round(sum((retrieval_recall and not is_correct)::int)::double / count(*), 4) as generation_only_fail_rate, sum(tokens_used)::bigint as total_tokens from cases group by model),
pipe as (select b.*, p.median_latency_s, p.p95_latency_s from b left join pct p using (model))"""


@query("A16 H61", f"with {_PIPE} select * from pipe")
def retrieval_model_metrics(spark, d):
    return mt.pipeline_metrics(adapters.case_results(spark, d))


@query(
    "A17",
    f"""with {CASES_SQL}, ok as (select * from cases where error is null), {_PCT.format(src='ok', p95=_P95_WEB)},
    b as (select model, count(*) as num_cases, count(*) filter (where error is null) as num_completed, count(*) filter (where error is not null) as num_errors,
      round(sum(is_correct::int)::double / count(*), 4) as accuracy, round(avg(latency_seconds) filter (where error is null), 3) as mean_latency_s,
      round(avg(num_sources) filter (where error is null), 2) as avg_sources_per_case from cases group by model)
    select b.*, p.median_latency_s, p.p95_latency_s from b left join pct p using (model)""",
)
def web_search_metrics(spark, d):
    return mt.web_search_metrics(adapters.case_results(spark, d))


@query(
    "H61",
    f"""with {CASES_SQL} select case_idx, not retrieval_recall and is_correct as retrieval_only_fail, retrieval_recall and not is_correct as generation_only_fail from cases""",
)
def failure_attribution(spark, d):
    return mt.attribute_failures(adapters.case_results(spark, d)).select("case_idx", "retrieval_only_fail", "generation_only_fail")


@query(
    "A19",
    f"with {CASES_SQL}, c as (select model, match_type, count(*) as n from cases group by all) select model, string_agg(match_type || '=' || n, ',' order by match_type) as breakdown from c group by model",
)
def match_map(spark, d):
    m = mt.match_breakdown(adapters.case_results(spark, d))
    return m.select("model", F.array_join(F.transform(F.map_entries("match_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("breakdown"))


@query(
    "A20",
    f"""with {CASES_SQL}, c as (select model, coalesce(difficulty, 'unknown') as difficulty, is_correct from cases)
    select coalesce(model, 'all') as model, coalesce(difficulty, 'all') as difficulty, count(*) as total, sum(is_correct::int)::bigint as correct,
      round(sum(is_correct::int)::double / count(*), 4) as accuracy from c group by cube(model, difficulty)""",
)
def difficulty_cube(spark, d):
    return mt.difficulty_breakdown(adapters.case_results(spark, d))


MODELS = ("click", "error", "purchase", "signup", "view")
GRID = ("pipeline_accuracy", "retrieval_recall", "retrieval_precision", "median_latency_s", "p95_latency_s", "num_cases")


@query(
    "A21",
    "with " + _PIPE + ", l as (" + " union all ".join(f"select '{g}' as metric, model, {g}::double as v from pipe" for g in GRID) + ") select metric, "
    + ", ".join(f"max(case when model = '{m}' then v end) as {m}" for m in MODELS) + " from l group by metric",
)
def model_pivot(spark, d):
    return mt.comparison_grid(mt.pipeline_metrics(adapters.case_results(spark, d)), GRID, MODELS)


@query(
    "A29",
    f"""with {CASES_SQL}, price(model, p) as (values ('click', 0.75::double), ('view', 2.5::double)),
    t as (select model, sum(tokens_used)::bigint as total_tokens from cases group by model)
    select model, total_tokens, round(total_tokens * p / 1e6, 6) as cost_usd from t left join price using (model)""",
)
def token_cost(spark, d):
    prices = spark.createDataFrame([("click", 0.75), ("view", 2.5)], "model string, price_per_m double")
    return mt.token_cost(adapters.case_results(spark, d), prices)


@query(
    "A26 U6",
    "select event_type as configuration, round(avg(case when event_id % 6 = 0 then null else event_id % 5 + 1 end), 3) as mean_grade, count(case when event_id % 6 = 0 then null else 1 end) as graded from events group by all",
)
def mean_grade(spark, d):
    e = F.col("event_id")
    g = read_table(spark, d, "events").select(F.col("event_type").alias("configuration"), F.when(e % 6 != 0, (e % 5 + 1).cast("double")).alias("grade"))
    return mt.mean_grade(g, "configuration", "grade")


_PAIRS = """o as (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as text from benchmark),
pairs as (select item_id, text as a, case item_id % 4 when 0 then lower(text) when 1 then replace(lower(text), 'e', '') when 2 then replace(lower(text), ' ', '--') else reverse(text) end as b from o)"""


def _pairs(spark, d):
    b = read_table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    i, low = F.col("item_id") % 4, F.lower("text")
    other = F.when(i == 0, low).when(i == 1, F.replace(low, F.lit("e"), F.lit(""))).when(i == 2, F.replace(low, F.lit(" "), F.lit("--"))).otherwise(F.reverse("text"))
    return b.select("item_id", F.col("text").alias("a"), other.alias("b"))


@query(
    "H27 H28",
    f"""with {_PAIRS}, s as (select *, trim(lower(a)) as x, trim(lower(b)) as y from pairs),
    r as (select *, case when greatest(length(x), length(y)) = 0 then 1.0::double else 1 - levenshtein(x, y)::double / greatest(length(x), length(y)) end as sim from s)
    select item_id, round(sim, 6) as similarity,
      case when sim >= 0.8 then 'exact_match' when item_id % 3 = 0 then (case when item_id % 2 = 0 then 'semantic_match' else 'mismatch' end)
           when sim >= 0.6 then 'partial_match' else 'mismatch' end as match_type from r""",
)
def match_class(spark, d):
    p = _pairs(spark, d).withColumn("s", mt.edit_similarity(F.col("a"), F.col("b")))
    verdict = F.when(F.col("item_id") % 3 == 0, F.when(F.col("item_id") % 2 == 0, "Semantic_match  yes").otherwise("odd words"))
    return p.select("item_id", F.round("s", 6).alias("similarity"), mt.match_class(F.col("s"), verdict).alias("match_type"))


@query("H27")
def similarity_pairs(spark, d):
    """Longest-matching-block ratio; SQL has no counterpart, fixtures check it."""
    p = _pairs(spark, d).filter(mt.ratio_can_reach(F.col("a"), F.col("b"), 0.6))
    return p.select("item_id", F.round(mt.sequence_ratio()(F.col("a"), F.col("b")), 6).alias("ratio"))


_GROUPS = """g as (select distinct source as grp from documents), q as (
  select grp, greatest(50 // (select count(*) from g), 1) + case when row_number() over (order by grp) <= (case when 50 // (select count(*) from g) = 0 then 50 else 50 % (select count(*) from g) end) then 1 else 0 end as quota from g),
s as (select doc_id, source, md5('7|' || doc_id) as draw, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as r from documents)"""


@query("T9 J20", f"with {_GROUPS} select doc_id, source from s join q on q.grp = s.source where r <= quota order by draw, doc_id limit 50")
def stratified_sample(spark, d):
    return even_sample(read_table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50, seed=7).select("doc_id", "source")


@query(
    "J20",
    """with cov as (select distinct lang from documents where contains(lower(text), 'the')) select doc_id, lang from documents where lang in (select lang from cov)""",
)
def covered_chapters(spark, d):
    docs = read_table(spark, d, "documents")
    cover = docs.filter(F.lower("text").contains("the")).select("lang").distinct()
    return docs.join(cover, "lang", "left_semi").select("doc_id", "lang")
