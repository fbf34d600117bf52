"""The registered queries of this subpackage, with DuckDB text where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import chunk_tokens, golomb_dedup, ordinal_quality, partenum, sampled_pieces, secret_owners, soft_mixing, tree_forest, url_rules, warc_derivatives
from dossier.llm.boosted_pii import op11_boosted_pii
from dossier.llm.common import table
from dossier.llm.prefix_trie import SQL as OP12_SQL
from dossier.llm.prefix_trie import op12_prefix_trie
from dossier.llm.whitening import op13_whitening


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op3_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, each as written only by its digest and length, as its block is a column already."""
    records = warc_derivatives.derivatives(warc_derivatives.responses_from_pages(table(spark, sf_dir, "pages")))
    return records.withColumns({"record_sha256": F.sha2("record", 256), "record_length": F.octet_length("record").cast("long")}).drop("record")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.score(docs, ordinal_quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the owner, its part in one language for a repository."""
    return secret_owners.find_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("repeats")


OP3_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
flat as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
low as (select a, min(b) as m from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from sets left join low on a = doc_id
"""

OP6_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e, label from embeddings where label is not null and embedding is not null and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
edges as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
low as (select a, min(b) as m from reach group by a),
links as (select a, count(*) as n from edges group by a),
out as (select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id from embeddings left join low on low.a = vec_id left join links on links.a = vec_id)
select vec_id, n_links, component_id, vec_id = component_id as kept from out
"""

OP10_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_soft_mixing, op2_url_rules, op3_partenum, op4_warc_derivatives, op5_ordinal_quality, op6_tree_forest, op7_secret_owners, op8_sampled_pieces, op9_chunk_tokens, op10_golomb_dedup, op11_boosted_pii, op12_prefix_trie, op13_whitening)
}
LLM_SQL = {"op2_url_rules": url_rules.SQL, "op3_partenum": OP3_SQL, "op4_warc_derivatives": warc_derivatives.SQL, "op6_tree_forest": OP6_SQL, "op10_golomb_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL}
