"""Registered queries: text scalars, chunking, quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.operators import chunking as ch
from dossier.plans import adapters
from dossier.plans.oracle import SECTIONS, sentences, slug, strip, wc, words
from dossier.plans.registry import query
from dossier.sources.readers import read_table


def _docs(spark, d):
    return read_table(spark, d, "documents")


@query("H1", f"select doc_id, {slug('text')} as slug from documents")
def slug_texts(spark, d):
    return _docs(spark, d).select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("H2 H29", f"select doc_id, {wc('text')} as words, greatest(1, length(text) // 4) as tokens from documents")
def word_and_token_counts(spark, d):
    return _docs(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    "H4",
    f"""with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda z: {strip('z')}), lambda z: z <> '') as parts from documents)
    select doc_id, len(parts) as n, md5(coalesce(list_aggregate(parts, 'string_agg', '|'), '')) as digest from p""",
)
def para_split(spark, d):
    p = _docs(spark, d).select("doc_id", tx.paragraphs(F.col("text"), "\n").alias("parts"))
    return p.select("doc_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest"))


@query(
    "H5",
    f"""with p as (select doc_id, {sentences('text')} as a, {sentences('text', False)} as b from documents)
    select doc_id, len(a) as n, len(b) as n_any, md5(coalesce(list_aggregate(a, 'string_agg', '|'), '')) as digest from p""",
)
def sentence_split(spark, d):
    p = _docs(spark, d).select("doc_id", tx.sentences(F.col("text")).alias("a"), tx.sentences(F.col("text"), False).alias("b"))
    return p.select("doc_id", F.size("a").alias("n"), F.size("b").alias("n_any"), F.md5(F.array_join("a", "|")).alias("digest"))


@query(
    "H6",
    f"""with w as (select doc_id, {words('text')} as w from documents),
    p as (select doc_id, unnest(range(0, len(w), 500)) as s, w from w)
    select doc_id, s // 500 as part, len(w[s + 1 : s + 500]) as words, md5(list_aggregate(w[s + 1 : s + 500], 'string_agg', ' ')) as digest from p""",
)
def force_split(spark, d):
    p = _docs(spark, d).select("doc_id", F.posexplode(tx.split_every(F.col("text"), 500)).alias("pos", "piece"))
    return p.select("doc_id", F.col("pos").cast("long").alias("part"), tx.word_count(F.col("piece")).alias("words"), F.md5("piece").alias("digest"))


@query(
    "H7 H8",
    f"""with recursive s as (select doc_id, {sentences('text')} as a from documents),
    e as (select doc_id, unnest(a) as t, unnest(range(1, len(a) + 1)) as i from s),
    x as (select doc_id, i, t, {wc('t')} as n from e),
    f as (
      select doc_id, i, t, n, 0 as g, n as run from x where i = 1
      union all
      select x.doc_id, x.i, x.t, x.n,
        case when x.n > 120 then f.g + 1 + case when f.run > 0 then 0 else 0 end
             when f.n > 120 then f.g + 1
             when f.run + x.n > 120 then f.g + 1 else f.g end,
        case when x.n > 120 then 0 when f.n > 120 then x.n when f.run + x.n > 120 then x.n else f.run + x.n end
      from f join x on x.doc_id = f.doc_id and x.i = f.i + 1),
    packs as (select doc_id, g, string_agg(t, ' ' order by i) as t, sum(n) as n from f group by all)
    select doc_id, sum(case when n > 120 then ceil(n / 120.0)::bigint else 1 end)::bigint as pieces, sum(n)::bigint as words,
      min(md5(t)) filter (where n <= 120) as least_digest
    from packs group by doc_id""",
)
def pack_sentences(spark, d):
    """Sentence packing to 120 words; oversize sentences are hard split."""
    p = _docs(spark, d).select("doc_id", tx.pack_marked(tx.sentences(F.col("text")), 120).alias("p"))
    whole = F.transform(F.filter("p", lambda x: ~x["cut"]), lambda x: x["t"])
    return p.filter(F.size("p") > 0).select(
        "doc_id", F.size("p").cast("long").alias("pieces"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + tx.word_count(x["t"])).alias("words"),
        F.array_min(F.transform(whole, F.md5)).alias("least_digest"),
    )


HEADER = "[0-9]*[ \\t\\n]*All rights reserved[ \\t\\n]*"


@query(
    "H11 P3",
    f"""with c as (select doc_id, {strip(f"regexp_replace(text, '{HEADER}', '', 'g')")} as t from documents),
    l as (select doc_id, {strip(f"list_aggregate(list_filter(string_split(t, chr(10)), lambda z: not regexp_full_match({strip('z')}, '[0-9]+')), 'string_agg', chr(10))")} as t from c)
    select doc_id, {wc('t')} as words, md5(t) as digest from l where {wc('t')} > 0""",
)
def clean_text(spark, d):
    c = _docs(spark, d).select("doc_id", tx.clean_chunk(F.col("text"), HEADER).alias("t"))
    return c.select("doc_id", tx.word_count(F.col("t")).alias("words"), F.md5("t").alias("digest")).filter("words > 0")


@query(
    "H17",
    f"""select doc_id, md5({strip("regexp_replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_])-\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '\n+', chr(10), 'g'), '[ \t]+', ' ', 'g')")}) as digest
    from documents""",
)
def normalized_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_lines(F.col("text"))).alias("digest"))


@query("H18", "select doc_id, replace(lower(trim(source || ' ' || lang)), ' ', '_') as key from documents")
def name_keys(spark, d):
    return _docs(spark, d).select("doc_id", tx.name_key(F.concat_ws(" ", "source", "lang")).alias("key"))


@query(
    "P9 P10",
    """select doc_id from documents where contains(lower(text), 'the') and (contains(lower(text), ' license') or contains(lower(text), 'copyright')
       or contains(lower(text), 'terms') or contains(lower(text), 'ation'))""",
)
def phrase_filter(spark, d):
    low = F.lower("text")
    hit = tx.contains_any(low, (" license", "copyright", "terms", "ation"))
    return _docs(spark, d).filter(low.contains("the") & hit).select("doc_id")


@query(
    "P16 S5 T10",
    """select doc_id as case_idx, coalesce(nullif(case when doc_id % 3 = 0 then '' else lang end, ''), source, '') as case_prompt,
       coalesce(nullif(case when doc_id % 2 = 0 then source end, ''), lang, '') as ground_truth, source as source_chapter
       from documents order by doc_id limit 50""",
)
def alternative_fields(spark, d):
    from dossier.sources.readers import case_fields

    raw = _docs(spark, d).select(
        F.col("doc_id").alias("case_idx"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("patient_presentation"),
        F.col("source").alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("final_diagnosis"),
        F.col("lang").alias("answer"),
        F.col("source").alias("chapter"),
    )
    return case_fields(raw, limit=50)


@query(
    "H26 W9",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
    t as (select doc_id, pos, {strip("raw")} as raw from l),
    u as (select doc_id, pos, case when {wc('raw')} <= 4 and not contains(raw, 'ß') then upper(rtrim(raw, '.,!?')) else raw end as t from t),
    k as (select *, t = upper(t) and t <> lower(t) and {wc('t')} between 1 and 4 and not regexp_matches(t, '[0-9.:;/]')
        and not contains(t, 'TABLE') and not contains(t, 'FIGURE') and not contains(t, 'KEY POINTS') and not contains(t, 'APPROACH TO')
        and not contains(t, 'GENERAL CONSIDERATIONS') and not contains(t, 'DIFFERENTIAL DIAGNOSIS') and not contains(t, 'ESSENTIAL INQUIRIES') as h from u where t <> ''),
    s as (select *, sum(h::int) over (partition by doc_id order by pos) as g from k)
    select doc_id, max(t) filter (where h) as heading, md5(string_agg(t, ' ' order by pos) filter (where not h)) as body
    from s where g > 0 group by doc_id, g having count(*) filter (where not h) > 0""",
)
def heading_records(spark, d):
    from dossier.operators.layout import record_lines

    lines = F.transform(F.split("text", "\n"), tx.strip)
    raised = F.transform(lines, lambda s: F.when((tx.word_count(s) <= 4) & ~s.contains("ß"), F.upper(F.rtrim(s, F.lit(".,!?")))).otherwise(s))
    r = _docs(spark, d).select("doc_id", F.explode(record_lines(raised, tx.is_record_heading)).alias("r"))
    return r.select("doc_id", "r.heading", F.md5("r.body").alias("body"))


# ---- chunk build -------------------------------------------------------------------------------

_FWD = f"""{SECTIONS},
active as (select *, wc > 0 and wc < 50 as short from sections where not (wc = 0 and {strip('ess')} = '')),
lagged as (select *, lag(section) over w as ps, lag(short) over w as pshort from active window w as (partition by chapter order by seq)),
grp as (select *, sum(case when ps is null or ps <> section or not pshort then 1 else 0 end) over (partition by chapter order by seq) as g from lagged),
merged as (
  select chapter, max(seq) as seq, arg_max(section, seq) as section, arg_max(ess, seq) as ess, arg_max(short, seq) as kept_short,
         min(lo) as lo, max(hi) as hi, count(*) as merged_rows, {strip("string_agg(text, chr(10) || chr(10) order by seq)")} as text
  from grp group by chapter, g)"""

_PARTS = f"""{_FWD},
longs as (select chapter, section, seq, lo, hi, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda z: {strip('z')}), lambda z: z <> '') as ps from merged where {wc('text')} > 500),
par as (select chapter, seq, unnest(ps) as t, unnest(range(1, len(ps) + 1)) as i from longs),
pn as (select *, {wc('t')} as n from par),
pk as (
  select chapter, seq, i, t, n, 0 as g, n as run from pn where i = 1
  union all
  select pn.chapter, pn.seq, pn.i, pn.t, pn.n,
    case when pn.n > 500 or pk.n > 500 or pk.run + pn.n > 500 then pk.g + 1 else pk.g end,
    case when pn.n > 500 then 0 when pk.n > 500 or pk.run + pn.n > 500 then pn.n else pk.run + pn.n end
  from pk join pn on pn.chapter = pk.chapter and pn.seq = pk.seq and pn.i = pk.i + 1),
packs as (select chapter, seq, g, string_agg(t, ' ' order by i) as t from pk group by all),
cut as (select chapter, seq, g, 0 as s, t from packs where {wc('t')} <= 500
  union all select chapter, seq, g, s, list_aggregate(w[s * 500 + 1 : s * 500 + 500], 'string_agg', ' ') from (
    select *, unnest(range((len(w) + 499) // 500)) as s from (select *, {words('t')} as w from packs where {wc('t')} > 500))),
p0 as (
  select chapter, section, 'Essentials of Diagnosis' as subsection, seq, 0 as pos, lo, hi, {strip('ess')} as text from merged where {strip('ess')} <> ''
  union all
  select l.chapter, l.section, '', l.seq, row_number() over (partition by l.chapter, l.seq order by g, s), l.lo, l.hi, c.t from longs l join cut c on c.chapter = l.chapter and c.seq = l.seq
  union all
  select chapter, section, '', seq, 1, lo, hi, text from merged where {wc('text')} between 1 and 500),
parts as (select *, {wc('text')} as wc, row_number() over (partition by chapter, section, subsection order by seq, pos) as n from p0)"""

_LATE = f"""{_PARTS},
kept as (select * from parts where wc > 0),
a1 as (select *, lag(section) over (partition by chapter order by seq, pos) as ps from kept),
a2 as (select *, sum((ps is null or ps <> section)::int) over (partition by chapter order by seq, pos) as island,
              sum((ps is null or ps <> section or wc >= 50)::int) over (partition by chapter order by seq, pos) as head from a1),
hd0 as (select chapter, island, head, sum(wc) as words from a2 group by all),
hd as (select *, row_number() over (partition by chapter, island order by head) as hn from hd0),
tgt as (select h2.chapter, h2.head, h1.head as into_head from hd h1 join hd h2 on h1.chapter = h2.chapter and h1.island = h2.island
        and h1.hn = 1 and h2.hn = 2 and h1.words < 50),
fin as (select a2.*, coalesce(tgt.into_head, a2.head) as gid from a2 left join tgt on tgt.chapter = a2.chapter and tgt.head = a2.head),
lab as (select chapter, gid, arg_min((subsection, n), (seq, pos)) filter (where head = mh) as h from (
          select *, max(head) over (partition by chapter, gid) as mh from fin) group by chapter, gid),
chunks as (
  select f.chapter, any_value(f.section) as section, any_value(l.h[1]) as subsection, any_value(l.h[2]) as n, min(lo) as lo, max(hi) as hi,
         sum(wc)::int as wc, string_agg(text, chr(10) || chr(10) order by seq, pos) as text, min((seq, pos)) as o
  from fin f join lab l on l.chapter = f.chapter and l.gid = f.gid group by f.chapter, f.gid)"""

_CHUNK_ID = f"'corpus::' || {slug('chapter')} || '::' || {slug('section')} || '::' || (case when {strip('subsection')} = '' then 'main' else {slug('subsection')} end) || '::' || n"


@query(
    "H9 W2 P1",
    f"with {_FWD.replace('d.source as section', 'd.lang as section')} select chapter, seq, section, lo, hi, merged_rows, kept_short, {wc('text')} as words, md5(text) as digest from merged",
)
def forward_merge(spark, d):
    """Sections share their chapter's name here, so a chapter is one long island."""
    m = ch.forward_merge(ch.drop_empty(adapters.sections(spark, d).withColumn("section", F.col("chapter"))))
    return m.select("chapter", "seq", "section", "page_range.lo", "page_range.hi", "merged_rows", "kept_short", F.col("word_count").alias("words"), F.md5("text").alias("digest"))


@query(
    "D2 H8 W1 H3",
    f"with recursive {_PARTS} select {_CHUNK_ID} as chunk_id, seq, wc as words, md5(text) as digest from parts",
)
def chunk_ids(spark, d):
    from dossier.session import stage

    parts = stage(ch.emit_parts(ch.forward_merge(ch.drop_empty(adapters.sections(spark, d)))))
    p = parts.join(ch.number_parts(parts), ["chapter", "ord"])
    cid = tx.chunk_id("corpus", F.col("chapter"), F.col("section"), F.col("subsection"), F.col("n"))
    return p.select(cid.alias("chunk_id"), F.shiftright("ord", ch.PART_BITS).alias("seq"), F.col("word_count").alias("words"), F.md5("text").alias("digest"))


@query(
    "H10 W2 P2 P3 H3 W1",
    f"with recursive {_LATE} select {_CHUNK_ID} as chunk_id, chapter, section, subsection, lo, hi, wc as words, md5(text) as digest from chunks",
)
def chunk_structured(spark, d):
    c = ch.structured_chunks(adapters.sections(spark, d))
    return c.select("chunk_id", "chapter", "section", "subsection", "page_range.lo", "page_range.hi", F.col("word_count").alias("words"), F.md5("text").alias("digest"))


_SLIDE = f"""{SECTIONS},
full_ as (select seq, chapter, section, {words("'[' || chapter || ' / ' || section || ']' || chr(10) || text")} as w from sections where text <> ''),
offs as (select *, coalesce(sum(len(w)) over (order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as off from full_),
ws as (select seq, chapter, section, unnest(w) as word, off + unnest(range(len(w))) as g from offs),
win as (select unnest(range(greatest(0, ceil((g - 199) / 150.0))::bigint, g // 150 + 1)) as win, * from ws),
slides as (select win, arg_min(chapter, g) as chapter, arg_min(section, g) as section, count(*) as wc, string_agg(word, ' ' order by g) as text from win group by win)"""


@query(
    "W3",
    f"with {_SLIDE} select printf('baseline::%04d', win + 1) as chunk_id, chapter, section, wc as words, md5(text) as digest from slides",
)
def chunk_sliding(spark, d):
    c = ch.sliding_chunks(adapters.sections(spark, d))
    return c.select("chunk_id", "chapter", "section", F.col("word_count").alias("words"), F.md5("text").alias("digest"))


@query(
    "A1",
    f"""with recursive {_LATE} select count(*) as n, min(wc) as min_words, max(wc) as max_words, round(avg(wc), 4) as mean_words,
      median(wc) as median_words, round(stddev_samp(wc), 4) as stdev_words from chunks""",
)
def wc_stats(spark, d):
    return ch.word_count_stats(ch.structured_chunks(adapters.sections(spark, d)))


def _hist(source: str, buckets) -> str:
    low, rows = 0, []
    for label, high in buckets:
        cond = f"wc >= {low}" + (f" and wc < {high}" if high is not None else "")
        rows.append(f"select '{label}' as bucket, count(*) filter (where {cond}) as n from {source}")
        low = high
    return " union all ".join(rows)


@query(
    "H10 H9 W2",
    f"with recursive {_LATE.replace('d.source as section', 'd.lang as section')} select {_CHUNK_ID} as chunk_id, chapter, lo, hi, wc as words, md5(text) as digest from chunks",
)
def chunk_late_merge(spark, d):
    """The whole build with one section per chapter: long islands, many merges."""
    c = ch.structured_chunks(adapters.sections(spark, d).withColumn("section", F.col("chapter")))
    return c.select("chunk_id", "chapter", "page_range.lo", "page_range.hi", F.col("word_count").alias("words"), F.md5("text").alias("digest"))


@query("A2", f"with recursive {_LATE} {_hist('chunks', ch.CHUNK_BUCKETS)}")
def wc_hist_chunks(spark, d):
    return ch.word_count_histogram(ch.structured_chunks(adapters.sections(spark, d)))


@query("A3", f"with {SECTIONS} {_hist('sections', ch.SECTION_BUCKETS)}")
def wc_hist_sections(spark, d):
    return ch.word_count_histogram(adapters.sections(spark, d), ch.SECTION_BUCKETS)


@query("A4", f"with {SECTIONS} select count(distinct chapter) as chapters, count(*) filter (where ess <> '') as with_essentials, count(*) as n from sections")
def section_coverage(spark, d):
    return adapters.sections(spark, d).agg(
        F.count_distinct("chapter").alias("chapters"), F.count_if("has_essentials_box").alias("with_essentials"), F.count("*").alias("n")
    )


@query(
    "W14 T7",
    f"""with {SECTIONS}, x as (select *, nullif({strip('ess')}, '') as sub from sections),
    y as (select *, last_value(sub ignore nulls) over (partition by section order by seq rows between unbounded preceding and 1 preceding) as prev from x),
    z as (select section, seq, case when sub is not null and (prev is null or prev <> sub) then chr(10) || '### ' || sub || chr(10) || chr(10) || chr(10) else '' end || text as block from y)
    select section, seq as ord, md5(block) as digest from z""",
)
def section_blocks(spark, d):
    s = adapters.sections(spark, d).select("section", F.col("seq").alias("ord"), tx.strip(F.col("text")).alias("text"), F.col("essentials_text").alias("subsection"))
    return ch.section_blocks(s).select("section", "ord", F.md5("block").alias("digest"))


@query(
    "T7",
    """select event_id, 'a::' || event_type as prefix, case when user_id % 7 = 0 then 0 else user_id end as number,
       row_number() over (partition by event_type order by case when user_id % 7 = 0 then 0 else user_id end, event_id) as pos from events""",
)
def natural_id_order(spark, d):
    from dossier.operators.scans import range_scan

    tail = F.when(F.col("user_id") % 7 == 0, "x").otherwise(F.col("user_id").cast("string"))
    e = read_table(spark, d, "events").select("event_id", tx.natural_id_key(F.concat_ws("::", F.lit("a"), "event_type", tail)).alias("k"))
    keyed = e.select("event_id", "k.prefix", F.col("k.n").alias("number"))
    return range_scan(keyed, ["prefix"], ["number", "event_id"], {"pos": ("sum", F.lit(1))})


@query(
    "P4 P5",
    """select doc_id, coalesce(nullif(trim(case when doc_id % 5 = 0 then ' ' else source end), ''), lang) as section from documents
       where lang = 'en' and upper(source) in (select upper(min(source)) from documents union select upper(max(source)) from documents)""",
)
def chapter_filter(spark, d):
    docs = _docs(spark, d)
    wanted = docs.agg(F.min("source").alias("a"), F.max("source").alias("b")).select(F.explode(F.array(F.upper("a"), F.upper("b"))).alias("key"))
    named = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source"))
    picked = docs.filter("lang = 'en'").withColumn("key", F.upper("source")).join(wanted, "key", "left_semi")
    return picked.select("doc_id", tx.first_non_empty(tx.strip(named), F.col("lang")).alias("section"))
