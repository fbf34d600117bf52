"""Comparison of evidence approaches: per-approach metrics, composite scores, the recommended one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.privacy import query_is_private, safety_penalty
from dossier.functions.web import is_rejected

# Approach names with the stages that use a supplied response, and the tie-break order.
APPROACHES = {
    "deterministic_only": (),
    "llm_synthesis_only": ("synthesis",),
    "llm_claims_and_synthesis": ("claims", "synthesis"),
    "full_llm_council": ("claims", "conflict", "safety", "final", "synthesis"),
    "hybrid_recommended": ("claims", "synthesis"),
}
TIE_BREAK_ORDER = (
    "hybrid_recommended",
    "deterministic_only",
    "llm_claims_and_synthesis",
    "llm_synthesis_only",
    "full_llm_council",
)
RESULT_COLUMNS = (
    "approach", "total_queries", "accepted_count", "accept_with_caution_count", "rejected_count", "valid_json_rate",
    "privacy_pass_rate", "average_sources_per_query", "tier1_source_percentage", "tier2_source_percentage",
    "rejected_domain_leak_count", "average_claims_per_query", "conflict_detection_count", "safety_warning_count",
    "average_latency_seconds", "llm_failure_count", "deterministic_fallback_count", "source_quality_score",
    "evidence_completeness_score", "safety_score", "privacy_score", "overall_score",
)


def per_approach(questions: DataFrame, approaches: dict[str, tuple[str, ...]] = APPROACHES) -> DataFrame:
    """Every question once per approach, with one flag per stage (rows multiply by a fixed small list)."""
    stages = ("claims", "conflict", "safety", "final", "synthesis")
    rows = [
        F.struct(F.lit(name).alias("approach"), *[F.lit(s in used).alias(f"use_{s}") for s in stages])
        for name, used in approaches.items()
    ]
    return questions.withColumn("a", F.explode(F.array(*rows))).select(*questions.columns, "a.*")


def stage_value(use: Column, supplied: Column, deterministic: Column) -> Column:
    """The supplied response where the approach uses one and it is valid, else the deterministic value."""
    return F.when(use & supplied.isNotNull(), supplied).otherwise(deterministic)


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 4), F.lit(0.0))


def approach_metrics(results: DataFrame) -> DataFrame:
    """The comparison table.

    ``results``: approach, valid_json, latency_seconds, final_decision, safety_decision, summary,
    sanitized_query, deidentified, conflicts (array), sources array<struct(source_tier, domain)>,
    claims array<struct(claim, supporting_sources)>, llm_failure_count, deterministic_fallback_count.
    Arrays are reduced inside the row, so one grouped pass with partial sums is enough.
    """
    ok = F.col("valid_json")

    def size_where(arr: str, cond) -> Column:
        return F.size(F.filter(arr, cond))

    def kept(c: Column) -> Column:
        return F.when(ok, c)

    penalty = safety_penalty(F.col("summary"))
    private = F.col("deidentified") & query_is_private(F.coalesce("sanitized_query", F.lit("")))
    row = results.select(
        "approach", "latency_seconds",
        ok.cast("int").alias("valid"),
        kept(F.col("final_decision")).alias("decision"),
        kept(F.size("sources")).alias("n_sources"),
        kept(size_where("sources", lambda s: s["source_tier"] == 1)).alias("t1"),
        kept(size_where("sources", lambda s: s["source_tier"] == 2)).alias("t2"),
        kept(size_where("sources", lambda s: is_rejected(s["domain"]))).alias("leaks"),
        kept(F.size("claims")).alias("n_claims"),
        kept(size_where("claims", lambda c: F.size(c["supporting_sources"]) > 0)).alias("supported"),
        kept((F.size("conflicts") > 0).cast("int")).alias("conflict"),
        kept(private.cast("int")).alias("private"),
        kept(penalty).alias("penalty"),
        kept(((F.col("safety_decision") != "accept") | (penalty > 0)).cast("int")).alias("warning"),
        kept(F.col("llm_failure_count")).alias("failures"),
        kept(F.col("deterministic_fallback_count")).alias("fallbacks"),
    )
    zero = F.lit(0)
    sums = ("n_sources", "t1", "t2", "leaks", "n_claims", "supported", "conflict", "private", "warning", "failures", "fallbacks")
    g = row.groupBy("approach").agg(
        F.count("*").alias("total"),
        F.sum("valid").alias("valid"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in sums],
        F.round(F.avg("latency_seconds"), 4).alias("average_latency_seconds"),
        F.coalesce(F.avg("penalty"), F.lit(0.0)).alias("mean_penalty"),
        F.count_if(F.col("decision") == "accept").alias("accepted_count"),
        F.count_if(F.col("decision") == "accept_with_caution").alias("accept_with_caution_count"),
        F.count_if(F.col("decision") == "reject").alias("rejected_count"),
    )
    n, ns = F.col("total"), F.col("n_sources")
    avg_claims = F.col("n_claims") / n
    quality = F.coalesce(_unit(F.try_divide(F.col("t1") * 1.0 + F.col("t2") * 0.8 + (ns - F.col("t1") - F.col("t2")) * 0.35, ns)), F.lit(0.0))
    completeness = _unit(F.least(avg_claims / 4, F.lit(1.0)) * 0.65 + F.col("supported") / F.greatest(F.col("n_claims"), F.lit(1)) * 0.35)
    safe = _unit(1.0 - F.col("mean_penalty"))
    safe = F.when(F.col("warning") > 0, F.greatest(F.lit(0.0), safe - F.least(F.lit(0.35), F.col("warning") / n * 0.2))).otherwise(safe)
    privacy = F.col("private") / n
    g = g.withColumn("q_", quality).withColumn("c_", completeness).withColumn("s_", safe).withColumn("p_", privacy)
    overall = F.col("q_") * 0.30 + F.col("c_") * 0.25 + F.col("s_") * 0.25 + F.col("p_") * 0.20
    return g.select(
        "approach",
        n.alias("total_queries"), "accepted_count", "accept_with_caution_count", "rejected_count",
        _pct(F.col("valid"), n).alias("valid_json_rate"),
        _pct(F.col("private"), n).alias("privacy_pass_rate"),
        F.round(ns / n, 4).alias("average_sources_per_query"),
        _pct(F.col("t1"), ns).alias("tier1_source_percentage"),
        _pct(F.col("t2"), ns).alias("tier2_source_percentage"),
        F.col("leaks").alias("rejected_domain_leak_count"),
        F.round(avg_claims, 4).alias("average_claims_per_query"),
        F.col("conflict").alias("conflict_detection_count"),
        F.col("warning").alias("safety_warning_count"),
        "average_latency_seconds",
        F.col("failures").alias("llm_failure_count"),
        F.col("fallbacks").alias("deterministic_fallback_count"),
        F.round("q_", 4).alias("source_quality_score"),
        F.round("c_", 4).alias("evidence_completeness_score"),
        F.round("s_", 4).alias("safety_score"),
        F.round("p_", 4).alias("privacy_score"),
        F.round(overall, 4).alias("overall_score"),
    )


def _position(approach: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(a) for a in TIE_BREAK_ORDER]), approach)
    return F.when(pos == 0, F.lit(len(TIE_BREAK_ORDER) + 1)).otherwise(pos)


def recommended(table: DataFrame) -> DataFrame:
    """The best overall score; ties follow the fixed order."""
    key = F.struct(F.col("overall_score").alias("s"), (-_position(F.col("approach"))).alias("p"))
    return table.agg(F.max_by("approach", key).alias("recommended_approach"), F.max("overall_score").alias("overall_score"))


def ordered_table(table: DataFrame) -> DataFrame:
    return table.orderBy(_position(F.col("approach")), "approach")


def review_counters(details: Column) -> list[Column]:
    """Failure and fallback counts out of array<struct(llm_failure, deterministic_fallback, llm_failure_count,
    deterministic_fallback_count)>."""

    def total(flag: str, count: str) -> Column:
        return F.aggregate(
            details, F.lit(0),
            lambda a, x: a + F.coalesce(x[count], F.lit(0)) + F.coalesce(x[flag], F.lit(False)).cast("int"),
        )

    return [
        total("llm_failure", "llm_failure_count").alias("llm_failure_count"),
        total("deterministic_fallback", "deterministic_fallback_count").alias("deterministic_fallback_count"),
    ]
