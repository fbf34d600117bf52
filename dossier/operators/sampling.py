"""Repeatable even samples over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def even_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """About n / groups rows per group, the remainder to the first groups by name, at least one each,
    cut to ``n`` in all. The draw is ordered by a hash of the key, so it repeats and needs no shuffle of
    unpicked rows: each task keeps at most the largest quota per group.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    groups = df.select(group).distinct()
    total = groups.count()
    if total == 0:
        return df.withColumn("draw", draw)
    base, extra = divmod(n, total)
    most = max(base, 1) + (1 if extra else 0)
    w = Window.partitionBy(group).orderBy("draw", key)
    picked = df.withColumn("draw", draw).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    named = groups.orderBy(group).limit(extra).withColumn("_more", F.lit(1)) if extra else groups.limit(0).withColumn("_more", F.lit(1))
    quota = F.lit(max(base, 1)) + F.coalesce("_more", F.lit(0))
    kept = picked.join(named, group, "left").filter(F.col("_r") <= quota).drop("_r", "_more")
    return kept.orderBy("draw", key).limit(n)
