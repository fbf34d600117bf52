"""Shapes the physical plans must keep."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.functions import web
from dossier.operators import evidence, relational
from dossier.operators.scans import prefix_scan
from dossier.sources.readers import read_table

RUN = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(RUN))
def test_no_pair_joins(spark, sf, name):
    text = plan(RUN[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    text = plan(relational.last_n(o, "o_custkey", [F.col("o_orderdate").desc(), "o_orderkey"]))
    assert text.count("WindowGroupLimit") == 2


def test_scan_reads_only_the_needed_columns(spark, sf):
    text = plan(RUN["page_host"](spark, sf))
    assert "html" not in text and "ReadSchema: struct<page_id:bigint,url:string>" in text
    text = plan(RUN["patient_view"](spark, sf))
    assert "PushedFilters" in text


def test_blocked_scan_shuffles_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    text = plan(prefix_scan(df, ["k"], "o", {"n": ("sum", F.lit(1))}, block_bits=4))
    # rows once by (key, block); totals by (key, block), by key, and back by (key, block)
    assert text.count("Exchange hashpartitioning") <= 4


def test_policy_lookup_is_an_equi_join(spark, sf):
    policy = spark.createDataFrame([("example.com", 1)], "domain string, tier int")
    src = read_table(spark, sf, "pages").select("page_id", web.host(F.col("url")).alias("domain"))
    out = evidence.tier_by_policy(src, policy)
    assert "NestedLoop" not in plan(out)
    assert out.filter("source_tier = 1").count() == src.filter(web.under_any(F.col("domain"), ("example.com",))).count() > 0
