"""Second-stage ranking of candidates by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import bind, count_contained
from dossier.functions.web import query_terms


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default scorer: share of distinct query terms contained in the text, 6 decimals."""
    return bind(
        query_terms(query),
        lambda ts: F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(F.round(count_contained(ts, text) / F.size(ts), 6)),
    )


def batch_scorer(predict: Callable[[pd.Series, pd.Series], pd.Series]):
    """Wrap any (queries, texts) -> scores function as an Arrow scorer."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(predict(query, text), index=query.index, dtype="float64")

    return score


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, top: int, scorer=lexical_overlap) -> DataFrame:
    """Score candidates and keep the best ``top`` per query.

    ``candidates``: qid, id, distance, rank; ``queries``: qid, query; ``texts``: id, text. Only the
    candidates' texts meet the join; names follow the retrieval log.
    """
    pairs = candidates.join(texts, "id").join(queries, "qid")
    scored = pairs.select(
        "qid", "id", F.col("distance").alias("vector_distance"), F.col("rank").alias("original_rank"),
        scorer(F.col("query"), F.col("text")).alias("rerank_score"),
    )
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "original_rank")
    return (
        scored.withColumn("final_rank", F.row_number().over(w))
        .filter(F.col("final_rank") <= top)
        .withColumn("rank_change", F.col("original_rank") - F.col("final_rank"))
    )
