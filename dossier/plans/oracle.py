"""Small builders for the DuckDB side of the comparison."""

from __future__ import annotations

from dossier.functions.text import WS_CHARS

WS = "[" + WS_CHARS + "]"


def strip(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def words(x: str) -> str:
    return f"(case when {strip(x)} = '' then [] else regexp_split_to_array({strip(x)}, '{WS}+') end)"


def wc(x: str) -> str:
    return f"(case when coalesce({strip(x)}, '') = '' then 0 else len(regexp_split_to_array({strip(x)}, '{WS}+')) end)"


def slug(x: str) -> str:
    s = f"regexp_replace({strip(x)}, '^[»º▸•\\-–—]+{WS}*', '')"
    s = f"regexp_replace(lower({s}), '{WS}+', '_', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
    s = f"trim(regexp_replace({s}, '_+', '_', 'g'), '_')"
    return f"(case when {s} = '' then 'unknown' else left({s}, 40) end)"


def sentences(x: str, capital: bool = True) -> str:
    if capital:
        marked = f"regexp_replace({x}, '([.!?]){WS}+([A-Z])', '\\1\x01\\2', 'g')"
    else:
        marked = f"regexp_replace({x}, '([.!?]){WS}+', '\\1\x01', 'g')"
    return f"list_filter(list_transform(string_split({marked}, '\x01'), lambda z: {strip('z')}), lambda z: z <> '')"


SECTIONS = f"""sections as (
  select d.doc_id as seq, 'corpus' as source, d.lang as chapter, d.source as section, '' as subsection,
         {strip('d.text')} as text, d.doc_id as lo, d.doc_id as hi, {wc('d.text')} as wc,
         coalesce(case when l.quality = 1 then string_split(d.text, chr(10))[1] end, '') as ess
  from documents d left join labels l on l.doc_id = d.doc_id)"""
