"""Registered queries: page layout, sectioning, glyph repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import glyphs as gl
from dossier.functions import text as tx
from dossier.operators import glyph_repair as gr
from dossier.operators import layout as ly
from dossier.plans import adapters
from dossier.plans.oracle import SECTIONS, strip, wc
from dossier.plans.registry import query
from dossier.sources.readers import read_table

_DAMAGE = "translate(text, 'aeo', chr(57345) || chr(57346) || chr(57347))"
_PUA = "[\\x{E000}-\\x{F8FF}]"


@query("H13 J19", "select doc_id, md5(text) as digest, true as restored from documents")
def glyph_repair(spark, d):
    t = adapters.damaged(spark, d).withColumnRenamed("lang", "font")
    r = gr.repair_texts(t, adapters.glyph_map(spark, d), "damaged", "fixed")
    return r.select("doc_id", F.md5("fixed").alias("digest"), (F.col("fixed") == F.col("text")).alias("restored"))


@query(
    "H14",
    f"""with x as (select doc_id, regexp_extract_all({_DAMAGE}, '{_PUA}') as p from documents)
    select doc_id, len(p) as n, coalesce(list_aggregate(list_transform(p, lambda c: printf('U+%04X', unicode(c))), 'string_agg', ','), '') as codes from x""",
)
def residual_codes(spark, d):
    r = adapters.damaged(spark, d).select("doc_id", gl.residual_codes(F.col("damaged")).alias("c"))
    return r.select("doc_id", F.size("c").alias("n"), F.array_join("c", ",").alias("codes"))


@query("A7", f"with x as (select unnest(regexp_extract_all({_DAMAGE}, '{_PUA}')) as glyph from documents) select glyph, count(*) as n, printf('U+%04X', unicode(glyph)) as code from x group by glyph")
def glyph_frequency(spark, d):
    return gr.glyph_frequency(adapters.damaged(spark, d), "damaged")


def _flagged_words(spark, d):
    """Damaged words of every line, per language, each with the five words before and after it in its line."""
    lines = adapters.damaged(spark, d).select(F.col("lang").alias("font"), F.col("doc_id").alias("page"), F.posexplode(F.split("damaged", "\n")).alias("line", "text"))
    words = lines.select("font", "page", "line", F.explode_outer(gr.words_in_context(F.col("text"))).alias("w")).filter("w is not null")
    return words.select("font", "w.word", "page", "w.context", F.struct(F.col("page").alias("doc_id"), "line", "w.at").alias("ord"), gl.distinct_codes(F.col("w.word")).alias("residual_chars"))


def _word_counts(spark, d):
    return gr.word_counts(adapters.damaged(spark, d), "lang", "damaged")


def _glyph_counts(spark, d):
    return gr.glyph_counts(adapters.damaged(spark, d), "lang", "damaged")


_FLAGGED = f"""fl0 as (select doc_id, lang as font, unnest(string_split({_DAMAGE}, chr(10))) as context, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
fl1 as (select doc_id, font, pos, string_split(context, ' ') as ws, unnest(range(len(string_split(context, ' ')))) as wp from fl0),
fl as (select doc_id, font, pos, wp, ws[wp + 1] as word, list_aggregate(ws[greatest(wp - 4, 1):wp + 6], 'string_agg', ' ') as context from fl1),
flagged as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(word, '{_PUA}'), lambda c: printf('U+%04X', unicode(c))))) as codes from fl
  where regexp_matches(word, '{_PUA}'))"""


@query("A5", f"with {_FLAGGED} select font, count(*) as records from flagged group by font")
def flagged_per_font(spark, d):
    return gr.residual_by_font(gr.word_totals(adapters.damaged(spark, d), "lang", "damaged"))[0]


@query("A5 A30", f"with {_FLAGGED}, u as (select font, unnest(codes) as code from flagged) select font, code, count(*) as n from u group by all")
def codes_per_font(spark, d):
    return gr.residual_by_font(_glyph_counts(spark, d))[1]


@query("A30", f"with {_FLAGGED}, u as (select unnest(codes) as code from flagged) select code, count(*) as n from u group by all order by n desc, code limit 10")
def top_residual_codes(spark, d):
    return gr.top_codes(_glyph_counts(spark, d))


@query(
    "A6",
    f"""with {_FLAGGED}, x as (select font, word, row_number() over (partition by font order by encode(word)) as r from (select distinct font, word from flagged))
    select font, string_agg(word, ',' order by r) as samples from x where r <= 5 group by font""",
)
def font_samples(spark, d):
    s = gr.samples(gr.first_words(adapters.damaged(spark, d), "lang", "damaged", 5), "font", "word", 5)
    return s.select("font", F.array_join("samples", ",").alias("samples"))


@query(
    "A32",
    f"""with {_FLAGGED}, x as (select *, row_number() over (partition by font order by doc_id, pos, wp) as entry from flagged where font in ('de', 'fr'))
    select font, entry, md5(entry || '. "' || word || '"  (page ' || doc_id || ', residual PUA chars: ' || list_aggregate(codes, 'string_agg', ', ') || ', surrounding context: "' || context || '")') as digest from x""",
)
def request_blocks(spark, d):
    texts = adapters.damaged(spark, d).select(F.col("lang").alias("font"), F.col("doc_id").alias("page"), F.col("damaged").alias("text"))
    return gr.request_blocks_of_texts(texts, ("de", "fr")).select("font", "entry", F.md5("line").alias("digest"))


@query(
    "J18",
    f"""with {_FLAGGED}, u as (select distinct font, unnest(codes) as code from flagged)
    select font, code from u where not (font = 'en' and code = 'U+E001') and not (font = 'fr' and code = 'U+E003')""",
)
def new_glyph_entries(spark, d):
    proposed = gr.font_codes(adapters.damaged(spark, d), "lang", "damaged")
    existing = spark.createDataFrame([("en", "U+E001"), ("fr", "U+E003")], "font string, code string")
    return gr.new_entries(proposed, existing)


_CORR = """corr as (
  select doc_id * 10 + k as corr_id, doc_id as page, case when k = 0 then 'the' else 'zzz' || (doc_id % 7) end as original, case when k = 0 then 'THE' else 'x' end as corrected
  from documents, (values (0), (1)) t(k) where source <= 'src05' or true)"""


def _corrections(spark, d):
    rows = F.array(F.struct(F.lit(0).alias("k"), F.lit("the").alias("o"), F.lit("THE").alias("c")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("zzz"), (F.col("doc_id") % 7).cast("string")).alias("o"), F.lit("x").alias("c")))
    return read_table(spark, d, "documents").select("doc_id", F.explode(rows).alias("r")).select(
        (F.col("doc_id") * 10 + F.col("r.k")).alias("corr_id"), F.col("doc_id").alias("page"), F.col("r.o").alias("original"), F.col("r.c").alias("corrected")
    )


def _wide_sections(spark, d):
    s = adapters.sections(spark, d)
    return s.withColumn("page_range", F.struct(F.col("seq").alias("lo"), (F.col("seq") + F.col("seq") % 3).alias("hi"))).withColumn("text", tx.strip(F.col("text")))


@query(
    "J1",
    f"""with {SECTIONS}
    select seq, case when contains(text, 'the') or contains(ess, 'the') then 1 else 0 end as n_applied,
      md5(replace(text, 'the', 'THE')) as digest, replace(ess, 'the', 'THE') as essentials from sections""",
)
def correction_range_join(spark, d):
    c = gr.apply_corrections(_wide_sections(spark, d), _corrections(spark, d))
    return c.select("seq", "n_applied", F.md5("text").alias("digest"), F.col("essentials_text").alias("essentials"))


@query(
    "J1",
    f"""with {SECTIONS},
    corr as (select doc_id * 10 as corr_id, doc_id as page, 'the' as o from documents union all select doc_id * 10 + 1, doc_id, 'zzz' || (doc_id % 7) from documents),
    used as (
      select s.seq, min(c.corr_id) as corr_id from sections s join corr c on c.page between s.seq and s.seq + s.seq % 3
      where contains(s.text, c.o) or contains(s.ess, c.o) group by s.seq)
    select corr_id, page, o as original from corr where corr_id not in (select corr_id from used)""",
)
def unmatched_corrections(spark, d):
    corr = _corrections(spark, d)
    done = gr.apply_corrections(_wide_sections(spark, d), corr)
    return gr.unmatched_corrections(corr, done).select("corr_id", "page", "original")


# Words of three characters or more: a run that is too short holds no longer one, so none is missed by going on inside it.
_DICTIONARY_WORD = "[a-z][a-z'\\-.]{2,}+"


def _dictionary(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(_DICTIONARY_WORD), F.lit(0))
    return read_table(spark, d, "documents").select(F.explode_outer(words).alias("word")).filter("word is not null").distinct()


@query("S6", "select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-.]*')) as word from documents) where length(word) >= 3")
def dictionary_words(spark, d):
    return _dictionary(spark, d)


@query("H30 J19")
def glyph_solver(spark, d):
    """Iterative: each glyph's answer feeds the next one, so there is no single SQL statement for it."""
    return gr.solve_glyphs(adapters.damaged(spark, d), "damaged", _dictionary(spark, d))


@query(
    "H30 J19",
    f"""with w as (select unnest(regexp_extract_all(lower({_DAMAGE}), '[A-Za-z\\x{{E000}}-\\x{{F8FF}}][A-Za-z\\x{{E000}}-\\x{{F8FF}}''\\-.]*')) as word from documents),
    bank as (select word, count(*) as n from w where regexp_matches(word, '{_PUA}') group by word),
    dict as (select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-.]*')) as word from documents) where length(word) >= 3),
    t as (select g, c, n, replace(word, g, c) as r from bank, (select unnest(string_split('{adapters.DAMAGE_TO}', '')) as g), (select unnest(string_split('abcdefghijklmnopqrstuvwxyz-.' || chr(39), '')) as c)
      where contains(word, g))
    select g as glyph, c as candidate, sum(n)::bigint as score from t where r in (select word from dict) group by all""",
)
def candidate_scores(spark, d):
    """First-round scores of every unknown glyph: dictionary hits per candidate letter."""
    t = adapters.damaged(spark, d)
    return gr.score_glyphs(gr.damaged_words(t, "damaged"), adapters.DAMAGE_TO, _dictionary(spark, d), {})


_SCORE_WORD = "lower(replace(word, g, letter))"


@query(
    "H31",
    f"""with {_FLAGGED},
    dict as (select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-.]*')) as word from documents) where length(word) >= 3),
    b as (select font, word, unnest(codes) as code, count(*) as n from flagged group by font, word, codes),
    b2 as (select font, word, code, sum(n) as n, chr(('0x' || substr(code, 3))::int) as g from b group by all),
    t as (select *, unnest(string_split('etaoinshrdlcumwfgypbvkjxqz', '')) as letter, unnest(range(26)) as pos from b2),
    tok as (select font, code, letter, pos, n, regexp_replace({_SCORE_WORD}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') as token from t),
    allt as (select font, code, letter, pos, n, token from tok
      union all select font, code, letter, pos, n, unnest(list_filter(regexp_split_to_array(token, '[-/]'), lambda p: length(p) >= 3)) from tok),
    s as (select font, code, letter, pos, sum(n) as score from allt where token in (select word from dict) group by all)
    select font, code, arg_max(letter, (score, -pos)) as letter, max(score)::bigint as score from s group by font, code""",
)
def letter_scores(spark, d):
    return gr.letter_scores(_word_counts(spark, d), _dictionary(spark, d), shape=rf"\A{_DICTIONARY_WORD}\z")


# ---- layout ------------------------------------------------------------------------------------

_SPANS = f"""sp0 as (select doc_id as page, lang as chapter, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as block from documents),
sp as (select *, {wc('text')} as n, 'f' || (block % 40) as font, case when block % 2 = 0 then 0.0 else 300.0 end as x0 from sp0),
spans as (select *, case when n <= 3 then 11.0 when n <= 6 then 10.0 else 9.0 end as size, x0 + case when n > 30 then 500.0 else 280.0 end as x1 from sp)"""

_IN = lambda fs: "(" + ", ".join(f"'{f}'" for f in fs) + ")"
_ROLE = f"""case when {strip('text')} = '' then 'skip' when font in {_IN(ly.HEADER_FOOTER_FONTS)} and size >= 10 then 'skip'
  when size = 11.5 and font = 'f27' then 'essentials_header' when size = 9 and font = 'f27' then 'essentials_body'
  when size = 11 and contains(text, '»') then 'when_to_label' when size = 11 and font not in {_IN(ly.BODY_FONTS + ly.ESSENTIALS_FONTS)} then 'section_heading'
  when size = 10 then 'section_heading' when {strip('text')} in ('•', '»') and font in ('f8', 'f17') then 'bullet'
  when size = 9 and font in {_IN(ly.INLINE_LABEL_FONTS)} then 'inline_label' else 'body' end"""


@query("H15", f"with {_SPANS} select page, block, {_ROLE} as role from spans")
def span_roles(spark, d):
    return adapters.spans(spark, d).select("page", "block", ly.span_role(F.col("font"), F.col("size"), F.col("text")).alias("role"))


@query(
    "W15",
    f"""with {_SPANS}, c as (select page, block, case when x1 - x0 > 612 * 0.70 then 0 when (x0 + x1) / 2 < 306 then 1 else 2 end as column_class from spans)
    select page, block, column_class, row_number() over (partition by page order by column_class, block) as reading_pos from c""",
)
def reading_order(spark, d):
    return ly.reading_order(adapters.spans(spark, d)).select("page", "block", "column_class", "reading_pos")


@query(
    "H16 S4",
    f"""with {_SPANS}, r as (select *, {_ROLE} as role from spans), f as (select *, block // 3 as line3 from r where role <> 'skip')
    select page, line3 as line, arg_min(role, block) as role, arg_min(font, block) as font, arg_min(size, block)::double as size, md5({strip("string_agg(text, '' order by block)")}) as digest
    from f group by page, line3 having {strip("string_agg(text, '' order by block)")} <> ''""",
)
def line_assembly(spark, d):
    s = adapters.spans(spark, d).withColumn("span", F.col("block")).withColumn("line", F.floor(F.col("block") / 3)).withColumn("block", F.lit(0))
    return ly.assemble_lines(s).select("page", "line", "role", "font", "size", F.md5("text").alias("digest"))


@query("A8", f"with {_SPANS} select font, size::double as size, false as bold, count(*) as n from spans group by all")
def font_profile(spark, d):
    return gr.font_profile(adapters.spans(spark, d))


@query("P20", f"select doc_id as page from documents where {strip('text')} = ''")
def empty_pages(spark, d):
    return ly.pages_without_text(adapters.spans(spark, d))


_OUT = """outl as (select c_nationkey as book, c_custkey as start, c_name as title from customer),
rng as (select book, title, start, coalesce(lead(start) over (partition by book order by start, title), 2000000 + 1) as "end" from outl)"""


@query("W7 P6", f'with {_OUT} select book, title, start, "end" from rng where start >= 21')
def chapter_ranges(spark, d):
    o = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("start"), F.col("c_name").alias("title"))
    return ly.chapter_ranges(o, F.lit(2000000).cast("long"))


@query("P7", f"""with {_OUT} select book, title, greatest(start, 50) as start, least("end", 101) as "end" from rng where start >= 21 and start <= 100 and "end" > 50""")
def clamped_ranges(spark, d):
    return ly.clamp_ranges(chapter_ranges(spark, d), 50, 100).select("book", "title", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("A9", "select c_nationkey as level, count(*) as n from customer group by all")
def outline_levels(spark, d):
    return read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("level")).agg(F.count("*").alias("n")).orderBy("level")


@query(
    "A10",
    f"select doc_id as page, {' + '.join(f'contains(lower(text), {chr(39)}{k}{chr(39)})::int' for k in ('the', 'ation', 'les', 'chapter', 'ung'))} as hits, {wc('text')} as words from documents",
)
def keyword_hits_per_page(spark, d):
    kws = F.array(*[F.lit(k) for k in ("the", "ation", "les", "chapter", "ung")])
    return read_table(spark, d, "documents").select(
        F.col("doc_id").alias("page"), tx.count_contained(kws, F.col("text")).alias("hits"), tx.word_count(F.col("text")).alias("words")
    )


_TRACK = f"""el0 as (select lang as chapter, doc_id as page, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
el1 as (select chapter, page, pos, page::hugeint * 4294967296 + pos as ord, trim(raw, ' ') as text, {wc('raw')} as n from el0),
el as (select *, n <= 3 as top, n <= 6 as bound, n > 6 as body from el1 where text <> ''),
e2 as (select *, max(case when body then ord end) over w as lc, max(case when bound then ord end) over w as lb from el
  window w as (partition by chapter order by ord rows between unbounded preceding and 1 preceding)),
e3 as (select *, top or (bound and coalesce(lc, -1) > coalesce(lb, -1)) as resets from e2),
tr as (select *, sum(bound::int) over w as seg,
  coalesce(last_value(case when top then text end ignore nulls) over w, chapter) as section,
  coalesce(last_value(case when top then '' when bound then text end ignore nulls) over w, '') as subsection,
  coalesce(last_value(case when resets then page end ignore nulls) over w, 0) as page_start
  from e3 window w as (partition by chapter order by ord rows between unbounded preceding and current row)),
ends as (select chapter, max(page) as last_page from el group by chapter),
heads as (select chapter, seg - 1 as seg, page as next_page from tr where bound),
secs as (select tr.chapter, tr.seg, arg_min(page, ord) as first_page, arg_min(pos, ord) as first_line, any_value(section) as section, any_value(subsection) as subsection, any_value(page_start) as lo,
  coalesce(any_value(h.next_page), any_value(e.last_page)) as hi, {strip("string_agg(text, ' ' order by ord)")} as text
  from tr left join heads h on h.chapter = tr.chapter and h.seg = tr.seg join ends e on e.chapter = tr.chapter where body group by tr.chapter, tr.seg)"""


def _tracked(spark, d):
    e = adapters.elements(spark, d)
    return ly.track_sections(e), e.groupBy("chapter").agg(F.max("page").alias("last_page"))


@query("W8", f"with {_TRACK} select chapter, first_page, first_line, section, subsection, lo, hi, {wc('text')} as words, md5(text) as digest from secs")
def sectionise_lines(spark, d):
    t, ends = _tracked(spark, d)
    s = ly.build_sections(t, ends)
    return s.select("chapter", F.col("seq.page").alias("first_page"), F.col("seq.line").alias("first_line"), "section", "subsection", "page_range.lo", "page_range.hi", F.col("word_count").alias("words"), F.md5("text").alias("digest"))


_CTX = f"""{_TRACK},
numbered as (select *, sum(body::int) over (partition by chapter order by ord rows between unbounded preceding and 1 preceding) as nb,
   sum(body::int) over (partition by chapter order by ord) as bi from tr),
hits as (select *, seg - bound::int as segb, coalesce(nb, 0) as b0 from numbered where contains(text, 'é') or contains(text, 'ü')),
ctx as (select h.chapter, h.ord, string_agg(b.text, ' ' order by b.bi) as before from hits h join numbered b on b.body and b.chapter = h.chapter and b.seg = h.segb and b.bi between h.b0 - 2 and h.b0 group by all)"""


@query(
    "W13 P21",
    f"""with {_CTX} select h.chapter, h.page, h.pos as line, left({strip("coalesce(c.before, '') || ' [HERE] ' || h.text")}, 300) as context
      from hits h left join ctx c on c.chapter = h.chapter and c.ord = h.ord""",
)
def context_snippet(spark, d):
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit("([éü])"), F.lit(1)))
    e = adapters.elements(spark, d).withColumn("residual", marks)
    return ly.flag_unknown_glyphs(ly.track_sections(e)).select("chapter", "ord.page", "ord.line", "context")
