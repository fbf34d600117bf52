"""The supplied tables seen as the engine's own inputs; every adapter is a plain projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import word_count
from dossier.sources.readers import read_table


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections: language as chapter, source as section, first line of good ones as essentials."""
    docs = read_table(spark, d, "documents")
    good = read_table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    ess = F.when(F.col("good"), first_line).otherwise(F.lit(""))
    return docs.join(good, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.lit("corpus").alias("source"),
        F.col("lang").alias("chapter"),
        F.lit(0).alias("chapter_page_start"),
        F.col("source").alias("section"),
        F.lit("").alias("subsection"),
        "text",
        F.struct(F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi")).alias("page_range"),
        word_count(F.col("text")).alias("word_count"),
        (ess != "").alias("has_essentials_box"),
        ess.alias("essentials_text"),
    )


def _counted_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, pos, text, n: the lines of every text and their word counts.

    The count is made inside the explode: as a projection it would be put in place of every later use, many times a line.
    """
    counted = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text"), word_count(line).alias("n")))
    return docs.select("doc_id", "lang", F.posexplode_outer(counted).alias("pos", "line")).select("doc_id", "lang", "pos", "line.text", "line.n")


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as page elements: up to 3 words is a heading, 4 to 6 a minor heading, else body."""
    lines = _counted_lines(read_table(spark, d, "documents"))
    n = F.col("n")
    size = F.when(n <= 3, 11.0).when(n <= 6, 10.0).otherwise(9.0)
    return (
        lines.withColumn("text", F.btrim("text"))
        .filter("text <> ''")
        .select(
            F.col("lang").alias("chapter"),
            F.lit(0).cast("long").alias("chapter_start"),
            F.struct(F.col("doc_id").alias("page"), F.col("pos").alias("line")).alias("ord"),
            F.col("doc_id").alias("page"),
            size.alias("size"),
            F.when(n <= 6, "section_heading").otherwise("body").alias("role"),
            F.col("lang").alias("font"),
            "text",
        )
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as styled spans of a two-column page, one span per line."""
    lines = _counted_lines(read_table(spark, d, "documents")).filter("pos is not null")
    n = F.col("n")
    x0 = F.when(F.col("pos") % 2 == 0, 0.0).otherwise(300.0)
    y0 = F.col("pos").cast("double")
    return lines.select(
        F.col("lang").alias("chapter"),
        F.col("doc_id").alias("page"),
        F.col("pos").cast("long").alias("block"),
        F.lit(0).alias("line"),
        F.lit(0).alias("span"),
        F.concat(F.lit("f"), (F.col("pos") % 40).cast("string")).alias("font"),
        F.when(n <= 3, 11.0).when(n <= 6, 10.0).otherwise(9.0).alias("size"),
        F.struct(
            x0.alias("x0"), y0.alias("y0"), (x0 + F.when(n > 30, 500.0).otherwise(280.0)).alias("x1"), (y0 + 1.0).alias("y1")
        ).alias("bbox"),
        F.lit(612.0).alias("page_width"),
        "text",
    )


# The letters damaged in test text and the private-use glyphs that stand for them.
DAMAGE_FROM = "aeo"
DAMAGE_TO = "\ue001\ue002\ue003"


def damaged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their damaged text, made by byte searches: a translate looks every character of it up."""
    docs, text = read_table(spark, d, "documents"), F.col("text")
    for letter, glyph in zip(DAMAGE_FROM, DAMAGE_TO, strict=True):
        text = F.replace(text, F.lit(letter), F.lit(glyph))
    return docs.withColumn("damaged", text)


def glyph_map(spark: SparkSession, d: str) -> DataFrame:
    """(font, entries): one entry list per language, since languages play the fonts."""
    entries = F.array(
        *[F.struct(F.lit(g).alias("glyph"), F.lit(r).alias("replacement")) for g, r in zip(DAMAGE_TO, DAMAGE_FROM)]
    )
    return read_table(spark, d, "documents").select(F.col("lang").alias("font")).distinct().withColumn("entries", entries)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("chapter")
    )


def chapter_queries(spark: SparkSession, d: str) -> DataFrame:
    """One gold query per chapter: the mean of its vectors. Accepted chapters are the own and the next one."""
    parts = read_table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n_labels = F.lit(10)
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("p")).select(
        F.col("label").alias("qid"),
        F.transform("p", lambda e: e["m"]).alias("embedding"),
        F.col("label").alias("expected_chapter"),
        F.array(F.col("label"), (F.col("label") + 1) % n_labels).alias("accepted_chapters"),
        F.when(F.col("label") % 3 != 0, F.concat(F.lit(""), (F.col("label") % 5).cast("string"))).alias("expected_section"),
        F.element_at(F.array(F.lit("symptom"), F.lit("condition"), F.lit("emergency")), F.col("label") % 3 + 1).alias("category"),
    )


def case_results(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark case rows: event type as model, value as latency."""
    e = F.col("event_id")
    difficulty = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"), F.lit(None).cast("string")), (e % 4 + 1).cast("int"))
    match = F.element_at(
        F.array(*[F.lit(x) for x in ("exact_match", "semantic_match", "partial_match", "mismatch")]), (e % 4 + 1).cast("int")
    )
    failed = e % 97 == 0
    return read_table(spark, d, "events").select(
        e.alias("case_idx"),
        F.col("event_type").alias("model"),
        F.col("value").alias("latency_seconds"),
        (e % 3 == 0).alias("is_correct"),
        (e % 2 == 0).alias("retrieval_recall"),
        ((e % 5) / F.lit(4)).alias("retrieval_precision"),
        match.alias("match_type"),
        difficulty.alias("difficulty"),
        (e % 500).alias("tokens_used"),
        (e % 7 != 0).alias("json_adherence"),
        (e % 11).cast("int").alias("num_sources"),
        F.when(failed, "timeout").alias("error"),
        F.when(~failed, F.concat(F.lit("dx "), (e % 9).cast("string"))).alias("system_diagnosis"),
    )


CASES_SQL = """cases as (
  select event_id as case_idx, event_type as model, value as latency_seconds, event_id % 3 = 0 as is_correct,
         event_id % 2 = 0 as retrieval_recall, (event_id % 5) / 4.0 as retrieval_precision,
         ['exact_match','semantic_match','partial_match','mismatch'][event_id % 4 + 1] as match_type,
         ['easy','medium','hard',null][event_id % 4 + 1] as difficulty, event_id % 500 as tokens_used,
         event_id % 7 <> 0 as json_adherence, event_id % 11 as num_sources,
         case when event_id % 97 = 0 then 'timeout' end as error,
         case when event_id % 97 <> 0 then 'dx ' || (event_id % 9) end as system_diagnosis
  from events)"""


def review_cases(spark: SparkSession, d: str) -> DataFrame:
    """One review case per document; the label decides its status."""
    docs = read_table(spark, d, "documents")
    labels = read_table(spark, d, "labels")
    status = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "rejected").otherwise("pending")
    report = F.concat(
        F.lit("## Primary Diagnosis\n- **"), F.col("source"), F.lit("** (confidence: high)\n\n## Clinical Reasoning\n"),
        F.col("text"), F.lit("\n\n## Recommended\nrest"),
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"),
        F.concat(F.lit("Person "), (F.col("doc_id") % 200).cast("string")).alias("patient_name"),
        status.alias("review_status"),
        F.nullif(status, F.lit("pending")).alias("doctor_decision"),
        F.when((status == "rejected") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("corrected "), F.col("lang"))).alias("doctor_diagnosis"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "emergency").otherwise("routine").alias("urgency"),
        F.col("source").alias("system_primary_diagnosis"),
        report.alias("report"),
        F.col("lang").alias("lang"),
    )


CASES_REVIEW_SQL = """review as (
  select d.doc_id as case_id, 'Person ' || (d.doc_id % 200) as patient_name,
         case when quality = 1 then 'confirmed' when quality = 0 then 'rejected' else 'pending' end as review_status,
         case when quality = 0 and d.doc_id % 2 = 0 then 'corrected ' || d.lang end as doctor_diagnosis,
         case when coalesce(toxic, 0) = 1 then 'emergency' else 'routine' end as urgency,
         d.source as system_primary_diagnosis, d.lang as lang,
         '## Primary Diagnosis' || chr(10) || '- **' || d.source || '** (confidence: high)' || chr(10) || chr(10)
           || '## Clinical Reasoning' || chr(10) || d.text || chr(10) || chr(10) || '## Recommended' || chr(10) || 'rest' as report
  from documents d left join labels l on l.doc_id = d.doc_id)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as messages, one minute apart, with an urgency word by text length."""
    word = F.element_at(F.array(F.lit("routine"), F.lit("urgent"), F.lit("emergency")), F.length("text") % 3 + 1)
    kind = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 3 == 1, "diagnosis").otherwise("question")).otherwise("text")
    return read_table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn"),
        F.col("role").alias("sender"),
        F.col("text").alias("content"),
        kind.alias("message_type"),
        word.alias("urgency"),
        F.timestamp_seconds(F.col("turn") * 60).alias("created_at"),
    )


MESSAGES_SQL = """messages as (
  select conv_id as session_id, turn, role as sender, text as content,
         case when role = 'assistant' then (case when turn % 3 = 1 then 'diagnosis' else 'question' end) else 'text' end as message_type,
         ['routine','urgent','emergency'][length(text) % 3 + 1] as urgency
  from conversations)"""


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search results of twenty requests; text and title come out of the markup."""
    from dossier.functions import web

    return read_table(spark, d, "pages").select(
        (F.col("page_id") % 20).alias("request_id"),
        F.col("page_id").alias("seq"),
        "url",
        web.host(F.col("url")).alias("domain"),
        web.page_title(F.col("html")).alias("title"),
        web.page_text(F.col("html")).alias("text"),
    )
