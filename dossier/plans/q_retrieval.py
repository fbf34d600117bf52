"""Registered queries: vector search, ranks, hit metrics, vector store upkeep, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import context_prefix
from dossier.operators import metrics, retrieval
from dossier.operators.rerank import rerank
from dossier.plans import adapters
from dossier.plans.oracle import SECTIONS, strip, words
from dossier.plans.registry import query
from dossier.sources.readers import read_table

DIM = 64

_MEANS = """parts as (select label, unnest(embedding) as x, unnest(range(64)) as dim from embeddings),
m as (select label, dim, avg(x::double) as m from parts group by all),
q as (select label as qid, list(m order by dim) as e from m group by label)"""

_COS = f"""{_MEANS},
dist as (
  select q.qid, v.vec_id as id, v.label as chapter,
         round(1.0 - list_sum(list_transform(list_zip(q.e, v.embedding), lambda z: z[1] * z[2]::double))
           / (sqrt(list_sum(list_transform(q.e, lambda z: z * z))) * sqrt(list_sum(list_transform(v.embedding, lambda z: z::double * z::double)))), 6) as distance
  from q, embeddings v),
r as (select *, row_number() over (partition by qid order by distance, id) as rank from dist)"""

_GOLD = """gold as (
  select qid, qid as expected_chapter, [qid, (qid + 1) % 10] as accepted,
         case when qid % 3 <> 0 then (qid % 5)::varchar end as expected_section,
         ['symptom','condition','emergency'][qid % 3 + 1] as category from q)"""

_RANKS = f"""{_COS}, {_GOLD},
fr as (
  select g.qid, g.category, g.expected_section,
         min(case when r.chapter = g.expected_chapter then r.rank end) as chapter_rank,
         min(case when list_contains(g.accepted, r.chapter) then r.rank end) as accepted_rank,
         min(case when contains(r.chapter::varchar, g.expected_section) then r.rank end) as section_rank
  from gold g left join r on r.qid = g.qid and r.rank <= 10 group by all)"""


def _search(spark: SparkSession, d: str, k: int, **kw) -> DataFrame:
    return retrieval.knn(adapters.vectors(spark, d), adapters.chapter_queries(spark, d), k, **kw)


def _ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = adapters.vectors(spark, d).select("id", "chapter", F.col("chapter").cast("string").alias("section"))
    results = _search(spark, d, k).join(v, "id")
    return retrieval.first_ranks(results, adapters.chapter_queries(spark, d))


@query("J11 T1 H62 W4", f"with {_COS} select qid::bigint as qid, id, distance, rank from r where rank <= 10")
def knn_cosine_topk(spark, d):
    return _search(spark, d, 10)


@query(
    "T3 J11 H62",
    f"""with {_MEANS}, dist as (
      select q.qid, v.vec_id as id,
             round(list_sum(list_transform(list_zip(q.e, v.embedding), lambda z: (z[1] - z[2]::double) * (z[1] - z[2]::double))), 6) as distance
      from q, embeddings v),
    r as (select *, row_number() over (partition by qid order by distance, id) as rank from dist)
    select qid::bigint as qid, id, distance, rank from r where rank <= 8""",
)
def knn_l2_topk(spark, d):
    return _search(spark, d, 8, metric="l2")


@query(
    "P8 J11 T1",
    f"""with {_COS}, f as (select qid, id, distance, row_number() over (partition by qid order by distance, id) as rank
      from dist where chapter = (qid + 3) % 10)
    select qid::bigint as qid, id, distance, rank from f where rank <= 5""",
)
def knn_filtered(spark, d):
    q = adapters.chapter_queries(spark, d).withColumn("where", (F.col("qid") + 3) % 10)
    return retrieval.knn(adapters.vectors(spark, d), q, 5, where=True)


@query(
    "A14 P8",
    f"""with {_COS}, f as (select qid, chapter, (qid + 3) % 10 as w, row_number() over (partition by qid order by distance, id) as rank
      from dist where chapter = (qid + 3) % 10),
    p as (select qid, bool_and(chapter = w) as ok from f where rank <= 5 group by qid)
    select count(*) as num_queries, round(avg(ok::int), 4) as pass_rate from p""",
)
def filter_pass_rate(spark, d):
    q = adapters.chapter_queries(spark, d).withColumn("where", (F.col("qid") + 3) % 10)
    v = adapters.vectors(spark, d)
    found = retrieval.knn(v, q, 5, where=True).join(v.select("id", "chapter"), "id").join(q.select("qid", "where"), "qid")
    return metrics.filter_pass_rate(found)


def _levels() -> str:
    cols = ["count(*) as num_queries", "count(expected_section) as num_with_section"]
    for level, col in (("strict", "chapter_rank"), ("multi", "accepted_rank"), ("section", "section_rank")):
        cond = " filter (where expected_section is not null)" if level == "section" else ""
        for n in (1, 3, 10):
            cols.append(f"coalesce(round(avg(coalesce({col} <= {n}, false)::int){cond}, 4), 0.0) as {level}_hit{n}")
        cols.append(f"coalesce(round(avg(coalesce(1.0 / {col}, 0.0)::double){cond}, 4), 0.0) as {level}_mrr")
    return ", ".join(cols)


@query("A11 A12 W6", f"with {_RANKS} select {_levels()} from fr")
def hit_mrr_levels(spark, d):
    return metrics.hit_metrics(_ranked(spark, d), 10)


@query(
    "A13",
    f"""with {_RANKS} select coalesce(category, 'all') as category, count(*) as num_queries,
      round(avg(coalesce(chapter_rank <= 1, false)::int), 4) as hit1, round(avg(coalesce(chapter_rank <= 3, false)::int), 4) as hit3,
      round(avg(coalesce(1.0 / chapter_rank, 0.0)::double), 4) as mrr from fr group by rollup(category)""",
)
def hit_mrr_by_category(spark, d):
    return metrics.hit_by_category(_ranked(spark, d))


@query(
    "W19 W6",
    f"""with {_RANKS} select qid::bigint as qid, chapter_rank, accepted_rank, section_rank,
      case when accepted_rank = 1 then 'HIT' when accepted_rank <= 3 then 'TOP3' when accepted_rank <= 10 then 'TOP10' else 'MISS' end as status
      from fr""",
)
def rank_status(spark, d):
    r = _ranked(spark, d)
    return r.select(
        F.col("qid").cast("long").alias("qid"), "chapter_rank", "accepted_rank", "section_rank",
        retrieval.status_label(F.col("accepted_rank"), 10).alias("status"),
    )


BITS = 6
_CODE = " + ".join(f"(case when {{v}}[{i + 1}] > 0 then {1 << i} else 0 end)" for i in range(BITS))


@query(
    "T12",
    f"""with {_COS}, near as (
      select dist.qid, dist.id, dist.distance from dist
      join embeddings v on v.vec_id = dist.id join q on q.qid = dist.qid
      where bit_count(xor(({_CODE.format(v='v.embedding')}), ({_CODE.format(v='q.e')}))) <= 2),
    rr as (select *, row_number() over (partition by qid order by distance, id) as rank from near)
    select qid::bigint as qid, id, distance, rank from rr where rank <= 10""",
)
def knn_bucketed(spark, d):
    b = retrieval.bucket_vectors(adapters.vectors(spark, d), BITS)
    return retrieval.bucketed_knn(b, adapters.chapter_queries(spark, d), 10, BITS, radius=2)


@query(
    "T12 A11",
    f"""with {_COS}, near as (
      select dist.qid, dist.id, dist.distance from dist
      join embeddings v on v.vec_id = dist.id join q on q.qid = dist.qid
      where bit_count(xor(({_CODE.format(v='v.embedding')}), ({_CODE.format(v='q.e')}))) <= 2),
    rr as (select *, row_number() over (partition by qid order by distance, id) as rank from near)
    select count(*) as expected, round(avg((rr.id is not null)::int), 4) as recall
    from r left join rr on rr.qid = r.qid and rr.id = r.id and rr.rank <= 10 where r.rank <= 10""",
)
def knn_bucketed_recall(spark, d):
    v, q = adapters.vectors(spark, d), adapters.chapter_queries(spark, d)
    approx = retrieval.bucketed_knn(retrieval.bucket_vectors(v, BITS), q, 10, BITS, radius=2)
    return retrieval.recall_against(approx, retrieval.knn(v, q, 10))


_ENCODED = f"""tok as (
  select 'd' as kind, doc_id as id, unnest({words('lower(text)')}) as w from documents
  union all select 'q', item_id, unnest({words('lower(text)')}) from benchmark),
place as (select w, (('0x' || left(md5(w), 8))::ubigint % {DIM})::int as dim from (select distinct w from tok)),
counts as (select kind, id, dim, count(*)::double as c from tok join place using (w) group by all),
norms as (select kind, id, sqrt(sum(c * c)) as n from counts group by all),
dots as (
  select a.id as qid, b.id as id, sum(a.c * b.c) as dp from counts a join counts b on a.dim = b.dim
  where a.kind = 'q' and b.kind = 'd' group by all),
lex as (
  select dots.qid, dots.id, round(1.0 - dp / (na.n * nb.n), 6) as distance from dots
  join norms na on na.kind = 'q' and na.id = dots.qid join norms nb on nb.kind = 'd' and nb.id = dots.id),
cand as (select * from (select *, row_number() over (partition by qid order by distance, id) as rank from lex) where rank <= 10)"""

_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda t: length(t) > 2))"


def _benchmark_candidates(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    enc = retrieval.hashed_words(DIM)
    docs = retrieval.encode(read_table(spark, d, "documents"), "doc_id", "text", enc, DIM).filter("error is null")
    items = retrieval.encode(read_table(spark, d, "benchmark"), "item_id", "text", enc, DIM).filter("error is null")
    return retrieval.knn(docs, items.select(F.col("id").alias("qid"), "embedding"), k)


@query("U1 J11 T1", f"with {_ENCODED} select qid, id, distance, rank from cand")
def encode_and_search(spark, d):
    return _benchmark_candidates(spark, d)


@query(
    "T2 U2 J12 W5",
    f"""with {_ENCODED}, s as (
      select c.qid, c.id, c.distance as vector_distance, c.rank as original_rank,
        case when len({_TERMS}) = 0 then 0.0 else
          round(len(list_filter({_TERMS}, lambda t: contains(lower(t2.text), t)))::double / len({_TERMS}), 6) end as rerank_score
      from cand c join documents t2 on t2.doc_id = c.id join benchmark b on b.item_id = c.qid),
    f as (select *, row_number() over (partition by qid order by rerank_score desc, original_rank) as final_rank from s)
    select *, original_rank - final_rank as rank_change from f where final_rank <= 3""",
)
def retrieve_rerank_delta(spark, d):
    texts = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return rerank(_benchmark_candidates(spark, d), items, texts, 3)


@query(
    "H54",
    f"""with {_ENCODED} select c.qid, md5(string_agg('--- Passage ' || c.rank || ' ---' || chr(10) || 'Chapter : ' || t.lang || chr(10) || 'Section : ' || t.source
        || '  [rerank score: ' || printf('%.4f', sqrt(c.distance)) || ']' || chr(10) || chr(10) || {strip('t.text')}, chr(10) || chr(10) order by c.rank)) as digest
      from cand c join documents t on t.doc_id = c.id group by c.qid""",
)
def passage_blocks(spark, d):
    """Numbered passages of the ten candidates of each query."""
    from dossier.functions.narrative import passage

    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    c = _benchmark_candidates(spark, d).join(docs, "id")
    p = passage(F.col("rank"), F.col("lang"), F.col("source"), F.col("text"), F.sqrt("distance"))
    rows = F.array_sort(F.collect_list(F.struct("rank", p.alias("p"))))
    return c.groupBy("qid").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["p"]), "\n\n")).alias("digest"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.trim("text").alias("truth"))


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("chapter"))
    return _benchmark_candidates(spark, d).join(docs, "id").select("qid", "id", "rank", "text", "chapter")


def _recall_sql(distinct: bool, longer: int) -> str:
    w = f"list_filter(string_split_regex(lower(trim(b.text)), '\\s+'), lambda x: x <> '' and length(x) > {longer})"
    w = f"list_distinct({w})" if distinct else w
    return f"""with {_ENCODED}, sh as (
      select b.item_id as qid, coalesce(len(list_filter({w}, lambda x: contains(lower(t.text), x)))::double / nullif(len({w}), 0), 0.0) as share
      from benchmark b left join cand c on c.qid = b.item_id left join documents t on t.doc_id = c.id)
    select qid, bool_or(share >= 0.4) as recalled, round(max(share), 6) as best_share from sh group by qid"""


@query("J13", _recall_sql(True, 0))
def keyword_recall_v1(spark, d):
    return metrics.keyword_recall(_truth(spark, d), _retrieved(spark, d))


@query("J14", _recall_sql(False, 3))
def keyword_recall_v2(spark, d):
    return metrics.keyword_recall(_truth(spark, d), _retrieved(spark, d), distinct=False, min_length=3)


@query(
    "J15",
    f"""with {_ENCODED} select b.item_id as qid, round(avg(case when t.lang = 'en' then 1.0 else 0.0 end), 6) as precision
      from benchmark b left join cand c on c.qid = b.item_id left join documents t on t.doc_id = c.id group by all""",
)
def retrieval_precision(spark, d):
    cases = read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit("EN").alias("source_chapter"))
    return metrics.chapter_precision(cases, _retrieved(spark, d))


@query(
    "W18",
    """with p as (
      select conv_id as session_id, text as chunk_id, 1 + turn // 4 as pass, turn as rank from conversations),
    r as (select *, row_number() over (partition by session_id, chunk_id order by pass, rank) as rn from p)
    select session_id, md5(chunk_id) as chunk_key, pass, rank from r where rn = 1""",
)
def cross_pass_dedup(spark, d):
    p = read_table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.md5("text").alias("chunk_key"),
        F.floor(F.col("turn") / 4 + 1).alias("pass"), F.col("turn").alias("rank"),
    )
    return retrieval.first_seen(p, ["session_id", "chunk_key"], ["pass", "rank"])


@query(
    "J2 S14",
    """select coalesce(d.doc_id, l.doc_id) as chunk_id, l.doc_id is not null as has_vector, d.doc_id is not null as has_chunk
       from documents d full outer join labels l on l.doc_id = d.doc_id where d.doc_id is null or l.doc_id is null""",
)
def alignment_report(spark, d):
    ids = read_table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    _, report = retrieval.align(ids, docs)
    return report.select("chunk_id", F.coalesce("has_vector", F.lit(False)).alias("has_vector"), F.coalesce("has_chunk", F.lit(False)).alias("has_chunk"))


@query(
    "S12 S13 X6",
    """with latest as (
      select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id)
    select c.c_custkey as key, coalesce(l.event_type, c.c_mktsegment) as state, coalesce(l.value, c.c_acctbal) as amount
    from customer c left join latest l on l.user_id = c.c_custkey
    union all
    select user_id, event_type, value from latest where user_id not in (select c_custkey from customer)""",
)
def upsert_latest(spark, d):
    old = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("amount"))
    new = read_table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("value").alias("amount"), F.col("event_id").alias("at")
    )
    return retrieval.upsert(old, new, "key", "at").select("key", "state", "amount")


@query(
    "W17",
    """with r as (select event_type || '-' || user_id as base, event_id, row_number() over (partition by event_type, user_id order by event_id) as n from events)
    select event_id, case when n > 1 then base || '_dup' || n else base end as unique_id from r""",
)
def duplicate_ids(spark, d):
    ids = read_table(spark, d, "events").select(F.concat_ws("-", "event_type", "user_id").alias("chunk_id"), F.col("event_id").alias("ord"))
    from dossier.operators.chunking import repair_ids

    return repair_ids(ids).select(F.col("ord").alias("event_id"), "unique_id")


@query(
    "P17",
    f"""with {SECTIONS} select seq as chunk_id, chapter, section, subsection, '[' || lo || ', ' || hi || ']' as page_range,
      wc as word_count, 'structured' as chunk_type, source from sections""",
)
def flat_metadata(spark, d):
    s = adapters.sections(spark, d).withColumn("chunk_id", F.col("seq")).withColumn("chunk_type", F.lit("structured"))
    return retrieval.metadata(s)


@query(
    "H12",
    f"""with {SECTIONS} select seq, md5('Chapter: ' || chapter || ' | Section: ' || section
        || case when ess <> '' then ' | Subsection: ' || ess else '' end || ' | ' || text) as prefixed from sections""",
)
def embedding_prefix(spark, d):
    from dossier.functions.text import strip

    s = adapters.sections(spark, d)
    return s.select("seq", F.md5(context_prefix(F.col("chapter"), F.col("section"), F.col("essentials_text"), strip(F.col("text")))).alias("prefixed"))
