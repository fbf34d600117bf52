"""Evaluation aggregates: hit rates, recall, exact order statistics, breakdowns, comparison grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import count_contained
from dossier.session import small_side, stage

# Prices per million tokens (input, output).
PRICES = {"gpt-5.4-mini": (0.75, 4.50), "gpt-5.4": (2.50, 10.00)}
QUANTILE_ACCURACY = 10000
BRACKET = 0.001


def _share(cond: Column) -> Column:
    return F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 4)


def _mrr(rank: Column) -> Column:
    return F.round(F.avg(F.coalesce(F.lit(1.0) / rank, F.lit(0.0))), 4)


def hit_metrics(ranks: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Hit@1, Hit@3, Hit@k and MRR: strict, multi-label and over the queries that name a section."""
    labelled = F.col("expected_section").isNotNull()
    cols = [F.count("*").alias("num_queries")]
    for level, col, cond in (("strict", "chapter_rank", None), ("multi", "accepted_rank", None), ("section", "section_rank", labelled)):
        rank = F.col(col)
        for n in (1, 3, k):
            hit = F.coalesce(rank <= n, F.lit(False)).cast("int")
            hit = hit if cond is None else F.when(cond, hit)
            cols.append(F.coalesce(F.round(F.avg(hit), 4), F.lit(0.0)).alias(f"{level}_hit{n}"))
        rr = F.coalesce(F.lit(1.0) / rank, F.lit(0.0))
        rr = rr if cond is None else F.when(cond, rr)
        cols.append(F.coalesce(F.round(F.avg(rr), 4), F.lit(0.0)).alias(f"{level}_mrr"))
    cols.append(F.count_if(labelled).alias("num_with_section"))
    return ranks.groupBy(*by).agg(*cols) if by else ranks.agg(*cols)


def hit_by_category(ranks: DataFrame) -> DataFrame:
    return ranks.rollup("category").agg(
        F.count("*").alias("num_queries"),
        _share(F.col("chapter_rank") == 1).alias("hit1"),
        _share(F.col("chapter_rank") <= 3).alias("hit3"),
        _mrr(F.col("chapter_rank")).alias("mrr"),
    ).withColumn("category", F.coalesce("category", F.lit("all")))


def filter_pass_rate(results: DataFrame) -> DataFrame:
    """Share of queries all of whose results obey the filter. results: qid, chapter, where."""
    per_query = results.groupBy("qid").agg(F.bool_and(F.col("chapter") == F.col("where")).alias("ok"))
    return per_query.agg(F.count("*").alias("num_queries"), _share(F.col("ok")).alias("pass_rate"))


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, tuple[float, Callable[[Column], Column]]]
) -> DataFrame:
    """Exact order statistics per group without gathering a group.

    ``picks``: name -> (nominal quantile, zero-based index as a function of n). A quantile sketch gives a
    narrow bracket around each index; counting checks the bracket (and widens it to the whole range
    when the sketch missed), and only the distinct values inside it are ranked.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    names = list(picks)
    grid = []
    for p, _ in picks.values():
        grid += [max(p - BRACKET, 0.0), min(p + BRACKET, 1.0)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", F.array(*[F.lit(g) for g in grid]), QUANTILE_ACCURACY).alias("q"),
    )
    for i, name in enumerate(names):
        sketch = (
            sketch.withColumn(f"lo_{name}", F.col("q")[2 * i])
            .withColumn(f"hi_{name}", F.col("q")[2 * i + 1])
            .withColumn(f"at_{name}", picks[name][1](F.col("n")).cast("long"))
        )
    sketch = small_side(stage(sketch.drop("q")))
    counted = rows.join(sketch, keys).groupBy(*keys).agg(
        *[F.count_if(F.col("v") < F.col(f"lo_{n}")).alias(f"below_{n}") for n in names],
        *[F.count_if(F.col("v") <= F.col(f"hi_{n}")).alias(f"upto_{n}") for n in names],
    )
    bracket = sketch.join(counted, keys)
    wide = [
        F.struct(
            F.lit(n).alias("pick"),
            F.col(f"at_{n}").alias("at"),
            F.when(F.col(f"below_{n}") <= F.col(f"at_{n}"), F.col(f"lo_{n}")).otherwise(F.col("least")).alias("lo"),
            F.when(F.col(f"below_{n}") <= F.col(f"at_{n}"), F.col(f"below_{n}")).otherwise(F.lit(0)).alias("below"),
            F.when(F.col(f"upto_{n}") > F.col(f"at_{n}"), F.col(f"hi_{n}")).otherwise(F.col("most")).alias("hi"),
        )
        for n in names
    ]
    targets = small_side(stage(bracket.select(*keys, F.array(*wide).alias("targets"))))
    inside = (
        rows.join(targets, keys)
        .withColumn("t", F.explode(F.filter("targets", lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))))
        .groupBy(*keys, "t.pick", "t.at", "t.below", "v")
        .agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy(*keys, "pick").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = inside.withColumn("cum", F.col("below") + F.sum("c").over(w)).filter(F.col("cum") > F.col("at"))
    return chosen.groupBy(*keys).agg(*[F.min(F.when(F.col("pick") == n, F.col("v"))).alias(n) for n in names])


def median_index(n: Column) -> Column:
    return F.floor(n / 2)


def p95_index(n: Column) -> Column:
    return F.least(F.floor(n * F.lit(0.95)), n - 1)


def p95_index_web(n: Column) -> Column:
    """The last element below 20 rows."""
    return F.when(n >= 20, F.floor(n * F.lit(0.95))).otherwise(n - 1)


def latency_percentiles(results: DataFrame, web: bool = False) -> DataFrame:
    stats = order_statistics(
        results, ["model"], "latency_seconds",
        {"median_latency_s": (0.5, median_index), "p95_latency_s": (0.95, p95_index_web if web else p95_index)},
    )
    return stats.select("model", F.round("median_latency_s", 3).alias("median_latency_s"), F.round("p95_latency_s", 3).alias("p95_latency_s"))


def _flag(name: str) -> Column:
    return F.round(F.sum(F.coalesce(F.col(name), F.lit(False)).cast("int")) / F.count("*"), 4)


def benchmark_metrics(results: DataFrame) -> DataFrame:
    """Per model: accuracy, latency, malformed-output rate, retrieval hit rate, tokens, completed, errors."""
    base = results.groupBy("model").agg(
        F.count("*").alias("num_cases"),
        F.count_if(F.col("error").isNull() | F.col("system_diagnosis").isNotNull()).alias("num_completed"),
        F.count_if(F.col("error").isNotNull() & F.col("system_diagnosis").isNull()).alias("num_errors"),
        _flag("is_correct").alias("accuracy"),
        F.round(F.avg("latency_seconds"), 3).alias("mean_latency_s"),
        F.round(1 - F.sum(F.col("json_adherence").cast("int")) / F.count("*"), 4).alias("json_error_rate"),
        _flag("retrieval_recall").alias("retrieval_hit_rate"),
        F.sum("tokens_used").alias("total_tokens"),
    )
    return base.join(latency_percentiles(results), "model", "left")


def attribute_failures(results: DataFrame) -> DataFrame:
    """Right without the evidence, or wrong with it; null for runs without retrieval."""
    return results.withColumn("retrieval_only_fail", ~F.col("retrieval_recall") & F.col("is_correct")).withColumn(
        "generation_only_fail", F.col("retrieval_recall") & ~F.col("is_correct")
    )


def pipeline_metrics(results: DataFrame) -> DataFrame:
    base = attribute_failures(results).groupBy("model").agg(
        F.count("*").alias("num_cases"),
        F.count("system_diagnosis").alias("num_completed"),
        _flag("is_correct").alias("pipeline_accuracy"),
        _flag("retrieval_recall").alias("retrieval_recall"),
        F.round(F.avg("retrieval_precision"), 4).alias("retrieval_precision"),
        _flag("retrieval_only_fail").alias("retrieval_only_fail_rate"),
        _flag("generation_only_fail").alias("generation_only_fail_rate"),
        F.sum("tokens_used").alias("total_tokens"),
    )
    return base.join(latency_percentiles(results), "model", "left")


def web_search_metrics(results: DataFrame) -> DataFrame:
    """Accuracy over all rows, latency and sources over the error-free ones."""
    fine = F.col("error").isNull()
    base = results.groupBy("model").agg(
        F.count("*").alias("num_cases"),
        F.count_if(fine).alias("num_completed"),
        F.count_if(~fine).alias("num_errors"),
        _flag("is_correct").alias("accuracy"),
        F.round(F.avg(F.when(fine, F.col("latency_seconds"))), 3).alias("mean_latency_s"),
        F.round(F.avg(F.when(fine, F.col("num_sources"))), 2).alias("avg_sources_per_case"),
    )
    return base.join(latency_percentiles(results.filter(fine), web=True), "model", "left")


def match_breakdown(results: DataFrame) -> DataFrame:
    """Match type counts per model as a map."""
    counts = results.groupBy("model", F.coalesce("match_type", F.lit("mismatch")).alias("match_type")).count()
    return counts.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_type", "count")))).alias("match_breakdown"))


def difficulty_breakdown(results: DataFrame) -> DataFrame:
    """Totals, correct and accuracy by model and difficulty, with all subtotals."""
    typed = results.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    return typed.cube("model", "difficulty").agg(
        F.count("*").alias("total"),
        F.sum(F.col("is_correct").cast("int")).alias("correct"),
        F.round(F.sum(F.col("is_correct").cast("int")) / F.count("*"), 4).alias("accuracy"),
    ).select(F.coalesce("model", F.lit("all")).alias("model"), F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "total", "correct", "accuracy")


def comparison_grid(metrics: DataFrame, names: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Metric rows, one column per model."""
    long = metrics.unpivot(["model"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def mean_grade(scores: DataFrame, by: str, score: str) -> DataFrame:
    return scores.groupBy(by).agg(F.round(F.avg(score), 3).alias("mean_grade"), F.count(score).alias("graded"))


def token_cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    totals = results.groupBy("model").agg(F.sum("tokens_used").alias("total_tokens"))
    return totals.join(prices, "model", "left").select(
        "model", "total_tokens", F.round(F.col("total_tokens") * F.col("price_per_m") / 1e6, 6).alias("cost_usd")
    )


def coverage_share(words: Column, text: Column) -> Column:
    """Share of words contained in the text; null without words."""
    return F.try_divide(count_contained(words, text), F.size(words))


def keyword_recall(cases: DataFrame, retrieved: DataFrame, threshold: float = 0.4, distinct: bool = True, min_length: int = 0) -> DataFrame:
    """True when any retrieved text of a case holds enough of the truth's words.

    ``cases``: qid, truth; ``retrieved``: qid, text. ``distinct`` with no length limit is the first form;
    repeated words longer than three characters the second.
    """
    w = F.filter(F.split(F.lower("truth"), "\\s+"), lambda x: (x != "") & (F.length(x) > min_length))
    w = F.array_distinct(w) if distinct else w
    shares = cases.select("qid", w.alias("w")).join(retrieved, "qid", "left")
    share = F.coalesce(coverage_share(F.col("w"), F.col("text")), F.lit(0.0))
    return shares.groupBy("qid").agg(F.bool_or(share >= threshold).alias("recalled"), F.round(F.max(share), 6).alias("best_share"))


def chapter_precision(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Share of retrieved rows from the truth's chapter, any case; 0 without chapter or results."""
    same = F.lower(F.col("chapter")) == F.lower(F.col("source_chapter"))
    joined = cases.select("qid", "source_chapter").join(retrieved.select("qid", "chapter"), "qid", "left")
    return joined.groupBy("qid").agg(F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("precision"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on trimmed lower-case text, in [0, 1]."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def sequence_ratio():
    """Arrow form of the longest-matching-block ratio on trimmed lower-case text."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [SequenceMatcher(None, (x or "").lower().strip(), (y or "").lower().strip()).ratio() for x, y in zip(a, b)],
            index=a.index, dtype="float64",
        )

    return ratio


def ratio_can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Length bound of the ratio; pairs that fail it need no comparison."""
    x, y = F.length(F.trim(a)), F.length(F.trim(b))
    return F.when(x + y == 0, F.lit(True)).otherwise(2 * F.least(x, y) / (x + y) >= threshold)


def match_class(similarity: Column, verdict: Column, partial: float = 0.6) -> Column:
    """Exact by similarity, else the supplied verdict, else partial or mismatch by similarity."""
    word = F.get(F.split(F.lower(F.trim(verdict)), "\\s+"), F.lit(0))
    return (
        F.when(similarity >= 0.8, "exact_match")
        .when(verdict.isNotNull() & word.isin("semantic_match", "partial_match", "mismatch"), word)
        .when(verdict.isNotNull(), "mismatch")
        .when(similarity >= partial, "partial_match")
        .otherwise("mismatch")
    )
