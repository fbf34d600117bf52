"""Web source scalars: host, trust tier, type, recency, relevance, reliability, page text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WS, bind, contains_any, count_contained, strip

# Trust tiers by domain suffix.
TIER_DOMAINS = {
    1: (
        "who.int", "cdc.gov", "nice.org.uk", "nih.gov", "ncbi.nlm.nih.gov",
        "pubmed.ncbi.nlm.nih.gov", "fda.gov", "ema.europa.eu",
    ),
    2: (
        "nejm.org", "thelancet.com", "bmj.com", "jamanetwork.com", "cochranelibrary.com",
        "acc.org", "heart.org", "diabetes.org", "idsociety.org",
    ),
    3: ("mayoclinic.org", "clevelandclinic.org", "hopkinsmedicine.org", "msdmanuals.com"),
}
UNKNOWN_TIER = 99

# Rejected domains and host keywords.
REJECTED_DOMAINS = (
    "reddit.com", "quora.com", "wikipedia.org", "healthline.com",
    "webmd.com", "verywellhealth.com", "medicalnewstoday.com",
)
REJECTED_KEYWORDS = ("blog", "forum", "forums", "substack", "medium.com")

# Domains used by the short search form.
SEARCH_DOMAINS = (
    "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov",
    "mayoclinic.org", "clevelandclinic.org", "uptodate.com",
    "medlineplus.gov", "who.int", "cdc.gov", "nice.org.uk",
    "bmj.com", "nejm.org", "thelancet.com", "nih.gov",
    "hopkinsmedicine.org", "merckmanuals.com", "medscape.com",
)

# Source type keyword groups, first group wins.
TYPE_KEYWORDS = {
    "guideline": ("guideline", "recommendation", "practice guideline", "clinical guidance"),
    "systematic_review": ("systematic review", "meta-analysis", "cochrane"),
    "journal_article": ("journal", "trial", "study", "article", "nejm", "lancet", "jama", "bmj"),
    "government": ("cdc", "nih", "fda", "ema", "who", "public health"),
    "hospital_reference": ("mayo clinic", "cleveland clinic", "hopkins", "msd manual"),
}

# Reliability weights.
TIER_SCORES = {1: 0.95, 2: 0.82, 3: 0.65, 99: 0.35}
GUIDELINE_BONUS = 0.08
GOVERNMENT_BONUS = 0.06
RECENCY_BONUS = 0.05
MISSING_DATE_PENALTY = 0.04
OLD_SOURCE_PENALTY = 0.12
RELEVANCE_WEIGHT = 0.12

# Page text limits and tags.
PAGE_CHARS = 16000
SNIPPET_CHARS = 500
SHORT_PAGE_CHARS = 2000
DROP_TAGS = ("script", "style", "nav", "footer", "header", "aside")
TEXT_TAGS = ("h1", "h2", "h3", "p", "li")
SHORT_TEXT_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")
DATE_NAMES = (
    "article:published_time", "article:modified_time", "date", "dc.date", "dc.date.issued", "last-modified",
)
VOID_TAGS = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())


def host(url: Column) -> Column:
    """Network location in lower case, without a leading www., with any port kept."""
    net = F.when(url.contains("://"), F.regexp_extract(url, "://([^/?#]*)", 1)).otherwise(url)
    return F.regexp_replace(F.lower(net), "^www\\.", "")


def suffixes(domain: Column) -> Column:
    """The host and every parent domain: a.b.c -> [a.b.c, b.c, c]."""

    def build(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        )

    return bind(F.split(domain, "\\."), build)


def under_any(domain: Column, domains: tuple[str, ...]) -> Column:
    """Exact or subdomain match against a fixed list."""
    return F.arrays_overlap(suffixes(domain), F.array(*[F.lit(d) for d in domains]))


def source_tier(domain: Column, tiers: dict[int, tuple[str, ...]] = TIER_DOMAINS) -> Column:
    def lowest(parts: Column) -> Column:
        out = F.lit(UNKNOWN_TIER)
        for tier in sorted(tiers, reverse=True):
            out = F.when(F.arrays_overlap(parts, F.array(*[F.lit(d) for d in tiers[tier]])), F.lit(tier)).otherwise(out)
        return out

    return bind(suffixes(domain), lowest)


def is_rejected(
    domain: Column,
    domains: tuple[str, ...] = REJECTED_DOMAINS,
    keywords: tuple[str, ...] = REJECTED_KEYWORDS,
) -> Column:
    return under_any(domain, domains) | contains_any(domain, keywords)


def source_type(title: Column, snippet: Column, domain: Column, tier: Column) -> Column:
    def classify(hay: Column) -> Column:
        out = F.when(tier == 1, F.lit("government")).otherwise(F.lit("unknown"))
        for name, keys in reversed(TYPE_KEYWORDS.items()):
            out = F.when(contains_any(hay, keys), F.lit(name)).otherwise(out)
        return out

    return bind(F.lower(F.concat_ws(" ", title, snippet, domain)), classify)


def date_year(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), "\\b(20[0-9]{2}|19[0-9]{2})\\b", 1).try_cast("int")


def query_terms(query: Column) -> Column:
    return F.array_distinct(
        F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 2)
    )


def relevance(query: Column, text: Column) -> Column:
    return bind(
        query_terms(query),
        lambda ts: F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(
            count_contained(ts, text) / F.size(ts) * F.lit(RELEVANCE_WEIGHT)
        ),
    )


def reliability(
    tier: Column, kind: Column, rejected: Column, year: Column, relevance_score: Column, current_year: int
) -> Column:
    base = F.lit(TIER_SCORES[UNKNOWN_TIER])
    for t, score in TIER_SCORES.items():
        base = F.when(tier == t, F.lit(score)).otherwise(base)
    bonus = F.when(kind == "guideline", F.lit(GUIDELINE_BONUS)).when(kind == "government", F.lit(GOVERNMENT_BONUS)).otherwise(F.lit(0.0))
    recency = (
        F.when(year.isNull(), F.lit(-MISSING_DATE_PENALTY))
        .when(F.lit(current_year) - year <= 5, F.lit(RECENCY_BONUS))
        .when(F.lit(current_year) - year >= 10, F.lit(-OLD_SOURCE_PENALTY))
        .otherwise(F.lit(0.0))
    )
    score = F.when(rejected, F.lit(0.0)).otherwise(base + bonus + recency + relevance_score)
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3)


def unescape(c: Column) -> Column:
    """The common character references; the Arrow form handles all of them."""
    for ref, ch in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(ch))
    return c


def drop_elements(html: Column, tags: tuple[str, ...] = DROP_TAGS) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    return html


def page_text(html: Column, tags: tuple[str, ...] = TEXT_TAGS) -> Column:
    """Flat form: the own text of every heading, paragraph and list item, in page order."""
    names = "|".join(tags)
    t = F.regexp_replace(drop_elements(html), "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, f"(?i)<(?:{names})(?:\\s[^>]*)?>", "\x01")
    t = F.regexp_replace(t, f"(?i)</(?:{names})\\s*>", "\x02")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    own = F.transform(
        F.split(t, "\x01"),
        lambda b, i: F.when(i > 0, strip(unescape(F.substring_index(b, "\x02", 1)))).otherwise(F.lit("")),
    )
    return strip(F.regexp_replace(F.array_join(F.filter(own, lambda b: b != ""), " "), WS + "+", " "))


def page_title(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, "(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>", 1)))


def tag_attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, quoted or bare; empty without one."""
    pattern = f"(?is)[\\s\"']{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))"
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def page_date(html: Column) -> Column:
    """The content of the first dated meta tag in the order of DATE_NAMES, else the first <time> element; ten characters.

    The tags are cut out of the page once. For each name the first tag with that ``property`` counts, else the first with that
    ``name``; one without content leaves the turn to the next name. Tags in comments do not count. Null without a date.
    """
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(bare, F.lit("(?is)<meta\\s[^>]*>"), F.lit(0))
    parsed = F.transform(tags, lambda t: F.struct(*[unescape(tag_attribute(t, a)).alias(a) for a in ("property", "name", "content")]))

    def chosen(metas: Column) -> Column:
        def tag(name: str) -> Column:
            return F.coalesce(F.get(F.filter(metas, lambda m: m["property"] == name), F.lit(0)), F.get(F.filter(metas, lambda m: m["name"] == name), F.lit(0)))

        return F.coalesce(*[F.nullif(tag(name)["content"], F.lit("")) for name in DATE_NAMES])

    time = "(?is)<time(\\s[^>]*)?>(.*?)(?:</time\\s*>|$)"
    inner = strip(F.regexp_replace(F.regexp_extract(bare, time, 2), "(?s)\\s*<[^>]*>\\s*", " "))
    timed = F.coalesce(F.nullif(tag_attribute(F.regexp_extract(bare, time, 1), "datetime"), F.lit("")), F.nullif(unescape(inner), F.lit("")))
    return F.when(F.lower(html).rlike("<meta|<time"), F.substring(F.coalesce(bind(parsed, chosen), timed), 1, 10))


class _Blocks(HTMLParser):
    """Text of wanted elements including everything nested inside them; dropped elements vanish.

    End tags close the nearest open element of that name and all inside it; unknown ones are ignored.
    """

    def __init__(self, wanted: tuple[str, ...], dropped: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.dropped = wanted, dropped
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[list[str]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        bucket = None
        if tag in self.dropped:
            self.hidden += 1
        elif tag in self.wanted and not self.hidden:
            bucket = []
            self.found.append(bucket)
        self.open.append((tag, bucket))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.open):
            return
        while self.open:
            name, _ = self.open.pop()
            if name in self.dropped:
                self.hidden -= 1
            if name == tag:
                return

    def handle_data(self, data):
        if self.hidden:
            return
        piece = data.strip()
        if piece:
            for _, bucket in self.open:
                if bucket is not None:
                    bucket.append(piece)


def _nested_text(html: str, tags: tuple[str, ...]) -> str:
    parser = _Blocks(tags, DROP_TAGS)
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(" ".join(b) for b in parser.found if b).split())


def nested_page_text(tags: tuple[str, ...] = TEXT_TAGS):
    """Arrow form of page_text that follows nested and unclosed markup."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda h: None if h is None else _nested_text(h, tags))

    return extract
