"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

Both name the response they come from (WARC-Refers-To), its target, date and payload digest; the metadata record also
carries the source's HTTP headers and what the page says about itself. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPTURE_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _uuid(seed: Column) -> Column:
    """A urn:uuid built from the first 128 bits of a SHA-256."""
    h = F.sha2(seed, 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses_from_pages(pages: DataFrame, date: str = CAPTURE_DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): record_id, target_uri, date, http_headers, payload, payload_digest.

    A null html is a response without payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select("page_id", _uuid(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"), _digest(html).alias("payload_digest"))


def _with(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def _replace(t: Column, pattern: str, end: str, by: str) -> Column:
    """Replace matches that finish with the string ``end``. What follows its last place is left out of the search: an opening
    mark there would look for it up to the end of the text, and many such marks would take quadratic time."""
    cut = lambda t, tail: F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(tail)), pattern, by), tail)
    return _with(t, lambda t: _with(F.substring_index(t, end, -1), lambda tail: cut(t, tail)))


def _without(t: Column, name: str) -> Column:
    """Elements with their content out, searched up to the last closing tag for the reason above."""
    cut = lambda t, head: F.concat(F.regexp_replace(head, rf"(?is)<{name}\b.*?</{name}\s*>", " "), F.substr(t, F.length(head) + 1))
    return _with(t, lambda t: _with(F.regexp_extract(t, rf"(?is)^.*</{name}\s*>", 0), lambda head: cut(t, head)))


def plain_text(html: Column) -> Column:
    """Visible text: comments, scripts and styles out, block ends as line breaks, tags out, five entities decoded, blanks folded.

    Time is linear in the length, also where marks are opened and never closed.
    """
    t = _replace(html, r"(?s)<!--.*?-->", "-->", " ")
    t = _without(_without(t, "script"), "style")
    t = _replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/title|/section|/article|/ul|/ol|/table)\b[^>]*>", ">", "\n")
    t = _replace(t, r"<[^>]*>", ">", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    def first(held: Column) -> Column:
        opened = F.left(held, F.length(held) - F.length(F.substring_index(held, ">", -1))).rlike("(?i)<title")
        return F.when(opened, F.regexp_extract(held, r"(?is)<title[^>]*>(.*?)</title", 1)).otherwise("")

    inner = _with(F.regexp_extract(html, r"(?is)^.*</title", 0), first)
    return F.trim(F.regexp_replace(inner, r"[ \t\r\n\f]+", " "))


def n_links_of(html: Column) -> Column:
    """Pieces between closing marks in which an opened link has a target; what comes before the last target of a piece decides."""
    linked = F.filter(F.split(html, ">"), lambda s: F.regexp_extract(s, r"(?is)^(.*)href\s*=", 1).rlike(r"(?i)<a\s"))
    return F.size(linked).cast("long")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response: warc_type, record_id, refers_to, target_uri, date, content_type, payload_digest, block, block_digest, content_length, record.

    ``record`` is the record as it stands in a WARC file. Header values lose line breaks. A null or empty payload gives
    an empty conversion block and metadata with zero counts; repeated responses give repeated records; an empty table
    gives none. Columns of ``responses`` beyond those it needs are ignored, but for ``page_id``, which is kept.
    """
    line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = responses.select("page_id", F.col("record_id").alias("refers_to"), line(F.col("target_uri")).alias("target_uri"), line(F.col("date")).alias("date"), F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("payload_digest", _digest(payload)).alias("payload_digest"), payload.alias("payload"))
    text = base.withColumn("text", plain_text(F.col("payload"))).withColumn("title", title_of(F.col("payload"))).withColumn("links", n_links_of(F.col("payload"))).withColumn("payload_length", F.octet_length("payload"))
    fields = F.concat(
        F.lit("title: "), "title", F.lit(f"{CRLF}outlinks: "), F.col("links").cast("string"), F.lit(f"{CRLF}payload-length: "), F.col("payload_length").cast("string"),
        F.lit(f"{CRLF}text-digest: "), _digest(F.col("text")), F.lit(CRLF), F.regexp_replace("http_headers", r"(?m)^(?=[^\r\n])", "source-header: "),
    )
    both = text.select("page_id", "refers_to", "target_uri", "date", "payload_digest", F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )).alias("r")).select("page_id", "refers_to", "target_uri", "date", "payload_digest", "r.*")
    named = both.withColumn("record_id", _uuid(F.concat("warc_type", F.lit(" "), F.coalesce("refers_to", F.lit(""))))).withColumn("block_digest", _digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), "warc_type", F.lit(f"{CRLF}WARC-Record-ID: "), "record_id", F.lit(f"{CRLF}WARC-Refers-To: "), F.coalesce("refers_to", F.lit("")),
        F.lit(f"{CRLF}WARC-Target-URI: "), "target_uri", F.lit(f"{CRLF}WARC-Date: "), "date", F.lit(f"{CRLF}WARC-Source-Payload-Digest: "), "payload_digest",
        F.lit(f"{CRLF}WARC-Block-Digest: "), "block_digest", F.lit(f"{CRLF}Content-Type: "), "content_type", F.lit(f"{CRLF}Content-Length: "), F.col("content_length").cast("string"), F.lit(CRLF + CRLF),
    )
    return named.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block", "block_digest", "content_length", F.concat(head, "block", F.lit(CRLF + CRLF)).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Compressed WARC files, one per partition. The sink ends each line, so a record's last line feed comes from it."""
    records.select(F.expr("left(record, length(record) - 1)").alias("value")).write.option("compression", "gzip").text(path)


SQL = r"""
with src as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
resp as (
  select *, sha256(coalesce(cast(page_id as varchar), '') || ' ' || url) as rh,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) as head
  from src),
t1 as (select *, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') as a from resp),
t2 as (select *, regexp_replace(regexp_replace(a, '(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/title|/section|/article|/ul|/ol|/table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') as b from t1),
t3 as (select *, replace(replace(replace(replace(replace(b, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as c from t2),
t4 as (select *, regexp_replace(regexp_replace(regexp_replace(c, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') as text,
   trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '[ \t\r\n\f]+', ' ', 'g')) as title,
   len(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=')) as links from t3),
named as (select *, '<urn:uuid:' || rh[1:8] || '-' || rh[9:12] || '-' || rh[13:16] || '-' || rh[17:20] || '-' || rh[21:32] || '>' as refers_to, 'sha256:' || sha256(html) as payload_digest from t4),
recs as (
  select page_id, refers_to, url, payload_digest, 'metadata' as warc_type, 'application/warc-fields' as content_type,
    'title: ' || title || chr(13) || chr(10) || 'outlinks: ' || links || chr(13) || chr(10) || 'payload-length: ' || strlen(html) || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(text) || chr(13) || chr(10)
      || 'source-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: Content-Length: ' || strlen(html) || chr(13) || chr(10) as block from named
  union all
  select page_id, refers_to, url, payload_digest, 'conversion', 'text/plain; charset=utf-8', text from named),
ids as (select *, sha256(warc_type || ' ' || refers_to) as dh from recs),
done as (
  select page_id, warc_type, '<urn:uuid:' || dh[1:8] || '-' || dh[9:12] || '-' || dh[13:16] || '-' || dh[17:20] || '-' || dh[21:32] || '>' as record_id,
    refers_to, regexp_replace(url, '[\r\n]+', ' ', 'g') as target_uri, '2024-01-01T00:00:00Z' as date, content_type, payload_digest, block, 'sha256:' || sha256(block) as block_digest, strlen(block) as content_length
  from ids),
framed as (
  select *, array_to_string(['WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to, 'WARC-Target-URI: ' || target_uri, 'WARC-Date: ' || date,
    'WARC-Source-Payload-Digest: ' || payload_digest, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length, '', block, '', ''], chr(13) || chr(10)) as record
  from done)
select * exclude (record), sha256(record) as record_sha256, strlen(record) as record_length
from framed
"""
