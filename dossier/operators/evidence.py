"""Web evidence per request: rank sources, extract claims, review, decide, summarise.

Everything is keyed by request_id. Source lists are cut to ``max_sources`` before anything is
collected, so the per-request arrays stay small whatever the size of a request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import web
from dossier.functions.privacy import is_unsafe
from dossier.functions.text import EMPTY_TEXTS, WS, contains_any, sentences, strip
from dossier.session import stage

# Words that mark a sentence as a claim.
CLAIM_KEYWORDS = (
    "guideline",
    "recommend",
    "should",
    "treatment",
    "diagnosis",
    "contraindication",
    "warning",
    "vaccine",
    "screening",
    "management",
    "antibiotic",
)
MIN_CLAIM_CHARS = 40
CLAIM_CHARS = 500
MAX_CLAIMS = 8
MAX_SOURCES = 5

# Conflict findings.
CONFLICT_BOTH = "Detected both recommendation and non-recommendation language."
CONFLICT_AVOID = "Detected possible first-line versus avoid language."
CONFLICT_CONTRA = "Detected possible contraindication affecting recommended action."


def tier_by_policy(sources: DataFrame, policy: DataFrame) -> DataFrame:
    """Trust tier from a policy table (domain, tier): the lowest tier of any parent domain, else 99.

    Distinct hosts are exploded into their suffixes and meet the policy in an equi join, so a host that
    owns most rows is looked up once.
    """
    hosts = sources.select("domain").distinct()
    suffixed = hosts.select("domain", F.explode(web.suffixes(F.col("domain"))).alias("suffix"))
    tiers = (
        suffixed.join(policy.withColumnRenamed("domain", "suffix"), "suffix")
        .groupBy("domain")
        .agg(F.min("tier").alias("source_tier"))
    )
    return sources.join(tiers, "domain", "left").withColumn("source_tier", F.coalesce("source_tier", F.lit(web.UNKNOWN_TIER)))


def score_sources(
    sources: DataFrame, current_year: int, rejected: Column | None = None, tier: Column | None = None
) -> DataFrame:
    """Add tier, type and reliability. ``sources``: request_id, seq, url, domain, title, snippet, date, query."""
    tiered = sources if tier is None and "source_tier" in sources.columns else sources.withColumn(
        "source_tier", web.source_tier(F.col("domain")) if tier is None else tier
    )
    typed = tiered.withColumn(
        "source_type", web.source_type(F.col("title"), F.col("snippet"), F.col("domain"), F.col("source_tier"))
    ).withColumn("is_rejected", web.is_rejected(F.col("domain")) if rejected is None else rejected)
    rel = web.relevance(F.col("query"), F.concat_ws(" ", "title", "snippet"))
    return typed.withColumn("year", web.date_year(F.col("date"))).withColumn(
        "reliability_score",
        web.reliability(F.col("source_tier"), F.col("source_type"), F.col("is_rejected"), F.col("year"), rel, current_year),
    )


def top_sources(scored: DataFrame, n: int = MAX_SOURCES) -> DataFrame:
    """Best ``n`` per request; ties keep the input order."""
    w = Window.partitionBy("request_id").orderBy(F.col("reliability_score").desc(), "seq")
    return scored.filter(F.col("url") != "").withColumn("source_rank", F.row_number().over(w)).filter(F.col("source_rank") <= n)


def candidates(results: DataFrame, scored: DataFrame, n: int = MAX_SOURCES) -> DataFrame:
    """Original result rows whose url is among the 2n best of their request."""
    best = top_sources(scored, 2 * n).select("request_id", "url")
    return results.join(best, ["request_id", "url"], "left_semi")


def extract_claims(
    sources: DataFrame, keywords: tuple[str, ...] = CLAIM_KEYWORDS, max_claims: int = MAX_CLAIMS
) -> DataFrame:
    """Sentences of the ranked sources that state a claim, distinct per request, first eight in source order.

    ``sources``: request_id, source_rank, url, source_tier, text, and optionally snippet, which stands in for a null or empty text.
    """
    body = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("snippet")) if "snippet" in sources.columns else F.col("text")
    s = sources.select(
        "request_id", "source_rank", "url", "source_tier", F.posexplode(sentences(body, need_capital=False)).alias("pos", "raw")
    )
    c = s.withColumn("claim", strip(F.regexp_replace("raw", WS + "+", " "))).drop("raw")
    c = c.filter((F.length("claim") >= MIN_CLAIM_CHARS) & contains_any(F.lower("claim"), keywords))
    rest = F.struct("source_rank", "pos", "claim", "url", "source_tier")
    first = c.groupBy("request_id", F.lower("claim").alias("key")).agg(F.min_by(rest, F.struct("source_rank", "pos")).alias("r"))
    w = Window.partitionBy("request_id").orderBy("source_rank", "pos")
    ranked = first.select("request_id", "r.*").withColumn("claim_no", F.row_number().over(w)).filter(F.col("claim_no") <= max_claims)
    confidence = F.when(F.col("source_tier") == 1, "high").when(F.col("source_tier") == 2, "moderate").otherwise("low")
    return ranked.select(
        "request_id", "claim_no", "source_rank", "url", F.substring("claim", 1, CLAIM_CHARS).alias("claim"), confidence.alias("confidence")
    )


def source_review(sources: DataFrame) -> DataFrame:
    """Tier counts, rejected domains and the decision of the source check."""
    t = F.col("source_tier")
    r = sources.groupBy("request_id").agg(
        F.count("*").alias("n_sources"),
        F.count_if(t == 1).alias("tier_1"),
        F.count_if(t == 2).alias("tier_2"),
        F.count_if(t == 3).alias("tier_3"),
        F.count_if(t == 99).alias("unknown"),
        F.count_if("is_rejected").alias("n_rejected"),
        F.array_sort(F.collect_list(F.when(F.col("is_rejected"), F.struct("source_rank", "domain")))).alias("rej"),
    )
    decision = (
        F.when(F.col("tier_1") + F.col("tier_2") == 0, "reject")
        .when((F.col("n_rejected") > 0) & (F.col("n_rejected") == F.col("n_sources")), "reject")
        .when(F.col("tier_1") > 0, "accept")
        .otherwise("accept_with_caution")
    )
    return r.withColumn("source_decision", decision).withColumn("rejected_domains", F.transform("rej", lambda x: x["domain"])).drop("rej")


def recency_review(sources: DataFrame, current_year: int) -> DataFrame:
    """Recent, old and undated urls with the decision of the recency check."""
    age = F.lit(current_year) - F.col("year")

    def urls(cond: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("source_rank", "url")))), lambda x: x["url"])

    r = sources.groupBy("request_id").agg(
        urls(age <= 5).alias("recent_sources"),
        urls(F.col("year").isNull()).alias("missing_dates"),
        urls(age >= 10).alias("old_sources"),
    )
    decision = (
        F.when(F.size("old_sources") > 0, "accept_with_caution")
        .when((F.size("missing_dates") > 0) & (F.size("recent_sources") == 0), "accept_with_caution")
        .otherwise("accept")
    )
    return r.withColumn("recency_decision", decision)


def claim_review(claims: DataFrame) -> DataFrame:
    """Claims of a request in order, conflict findings and unsafe wording."""
    r = claims.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda x: x["claim"]).alias("claims")
    )
    text = F.lower(F.array_join("claims", " "))
    found = F.array_compact(
        F.array(
            F.when(text.contains("recommend") & (text.contains("not recommend") | text.contains("do not recommend")), F.lit(CONFLICT_BOTH)),
            F.when(text.contains("first-line") & text.contains("avoid"), F.lit(CONFLICT_AVOID)),
            F.when(text.contains("contraindicated") & text.contains("should"), F.lit(CONFLICT_CONTRA)),
        )
    )
    return r.withColumn("conflicts", found)


def safety_decision(claims: Column, summary: Column) -> Column:
    said = F.concat_ws(" ", summary, F.array_join(claims, " "))
    return (
        F.when(is_unsafe(said), "reject").when(F.size(claims) == 0, "accept_with_caution").otherwise("accept")
    )


def final_decision(deidentified: Column, decisions: list[Column], reliable: Column, conflicts: Column) -> Column:
    rejected, cautious = F.lit(False), F.lit(False)
    for dcol in decisions:
        rejected = rejected | (dcol == "reject")
        cautious = cautious | (dcol == "accept_with_caution")
    return (
        F.when(~deidentified, "reject")
        .when(rejected, "reject")
        .when(~reliable, "reject")
        .when((F.size(conflicts) > 0) | cautious, "accept_with_caution")
        .otherwise("accept")
    )


def summary_text(question: Column, claims: Column, source_phrases: Column, conflicts: Column, limitations: Column) -> Column:
    """Cautious summary out of the first three claims, sources and limitations."""
    e = F.lit("")
    claimed = F.concat(
        F.lit("For physician review, guideline-level sources suggest the following preliminary evidence for: "),
        question, F.lit(". "), F.array_join(F.slice(claims, 1, 3), " "),
    )
    unclaimed = F.concat(
        F.lit("For physician review, reliable sources were identified for: "), question,
        F.lit(", but deterministic extraction did not produce a strong claim."),
    )
    body = F.concat(
        F.when(F.size(claims) > 0, claimed).otherwise(unclaimed),
        F.when(F.size(conflicts) > 0, F.concat(F.lit(" Potential conflict noted: "), F.array_join(conflicts, "; "), F.lit("."))).otherwise(e),
        F.when(F.size(limitations) > 0, F.concat(F.lit(" Limitations: "), F.array_join(F.slice(limitations, 1, 3), "; "), F.lit("."))).otherwise(e),
        F.lit(" Key reviewed sources: "), F.array_join(F.slice(source_phrases, 1, 3), "; "), F.lit("."),
        F.lit(" This is not a final diagnosis or direct patient treatment instruction; it requires clinician judgment."),
    )
    none = F.lit(
        "No reliable web evidence could be retrieved for this clinical question. "
        "This preliminary result requires clinician judgment and should not be used as a final diagnosis."
    )
    return F.when(F.coalesce(F.size(source_phrases), F.lit(0)) == 0, none).otherwise(body)


def review_requests(
    requests: DataFrame, sources: DataFrame, claims: DataFrame, current_year: int, safety_after_summary: bool = True
) -> DataFrame:
    """One row per request with every review, the final decision and the summary.

    ``requests``: request_id, question, deidentified, limitations; ``sources``: ranked and scored.
    """
    no_texts = F.expr(EMPTY_TEXTS)
    dated = F.when(F.col("date").isNotNull() & (F.col("date") != ""), F.concat(F.lit(", updated/published "), F.col("date"))).otherwise(F.lit(""))
    phrase = F.concat("title", F.lit(" ("), "domain", dated, F.lit(")"))
    phrases = sources.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_rank", phrase.alias("p")))), lambda x: x["p"]).alias("phrases")
    )
    r = (
        requests.join(source_review(sources), "request_id", "left")
        .join(recency_review(sources, current_year), "request_id", "left")
        .join(claim_review(claims), "request_id", "left")
        .join(phrases, "request_id", "left")
    )
    for c in ("claims", "conflicts", "phrases"):
        r = r.withColumn(c, F.coalesce(c, no_texts))
    r = r.withColumn("source_decision", F.coalesce("source_decision", F.lit("reject")))
    r = r.withColumn("recency_decision", F.coalesce("recency_decision", F.lit("accept")))
    r = r.withColumn("conflict_decision", F.lit("accept_with_caution"))
    q, lim = F.col("question"), F.col("limitations")
    r = r.withColumn("draft", summary_text(q, F.col("claims"), F.col("phrases"), no_texts, lim))
    r = r.withColumn("safety_decision", safety_decision(F.col("claims"), F.col("draft")))
    r = r.withColumn("summary", summary_text(q, F.col("claims"), F.col("phrases"), F.col("conflicts"), lim))
    reviews = [F.col(f"{n}_decision") for n in ("source", "recency", "conflict", "safety")]
    reliable = F.coalesce(F.col("tier_1") + F.col("tier_2"), F.lit(0)) > 0
    decided = final_decision(F.col("deidentified"), reviews, reliable, F.col("conflicts"))
    if safety_after_summary:
        decided = F.when(safety_decision(F.col("claims"), F.col("summary")) == "reject", "reject").otherwise(decided)
    return r.withColumn("final_decision", decided).drop("draft")


MAX_LIMITATIONS = 3


@dataclass(frozen=True)
class EvidenceFlow:
    """What a two-stage run leaves: the ranked sources, every limitation as a row, the claims, and one reviewed row per request."""

    sources: DataFrame
    limitations: DataFrame
    claims: DataFrame
    reviewed: DataFrame


def evidence_flow(
    requests: DataFrame,
    results: DataFrame,
    fetched: DataFrame,
    current_year: int,
    tier: Column | None = None,
    keywords: tuple[str, ...] = CLAIM_KEYWORDS,
    max_sources: int = MAX_SOURCES,
) -> EvidenceFlow:
    """Search results to reviewed evidence in two stages.

    The results are ranked as found; the first 2n of those whose url is among the 2n best are fetched. A fetched page replaces title,
    text, snippet and date; where the fetch failed or is missing, the search result stands in with its snippet as text. The outcome is
    ranked again and cut to n. Errors of the search, in result order, then those of the fetches become the request's limitations.

    ``requests``: request_id, question, deidentified. ``results``: request_id, seq, url, domain, title, snippet, date, query, error.
    ``fetched``: request_id, url, title, text, snippet, date, error; of several rows for a url the least counts. A blank domain is taken from the
    url, others are lower-cased. Results without a url only give their errors. Requests without results are reviewed as having none.
    Limitations stay rows; a request carries the first MAX_LIMITATIONS, as many as its summary names.
    """
    domain = F.coalesce(F.nullif(F.regexp_replace(F.lower(strip(F.col("domain"))), "^www\\.", ""), F.lit("")), web.host(F.col("url")))
    found = results.withColumn("domain", domain)
    picked = candidates(found, score_sources(found, current_year, tier=tier), max_sources)
    in_order = Window.partitionBy("request_id").orderBy("seq")
    picked = picked.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= 2 * max_sources).drop("_n")
    page = F.struct("title", "text", "snippet", "date", "error")
    pages = fetched.join(picked.select("request_id", "url").distinct(), ["request_id", "url"], "left_semi").groupBy("request_id", "url").agg(F.min(page).alias("page"))
    read = F.col("page").isNotNull() & (F.coalesce("page.error", F.lit("")) == "")
    new = lambda c, old: F.when(read, F.col(f"page.{c}")).otherwise(F.col(old)).alias(c)
    merged = stage(
        picked.join(pages, ["request_id", "url"], "left").select(
            "request_id", "seq", "url", "domain", "query", new("title", "title"), new("text", "snippet"), new("snippet", "snippet"), new("date", "date"),
            F.nullif(F.col("page.error"), F.lit("")).alias("error"),
        )
    )
    top = stage(top_sources(score_sources(merged.drop("error"), current_year, tier=tier), max_sources))
    said = lambda df, step: df.filter(F.coalesce("error", F.lit("")) != "").select("request_id", F.lit(step).alias("step"), "seq", "error")
    limits = said(results, 1).unionByName(said(merged, 2))
    first = limits.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("step", "seq", "error"))).filter(F.col("_n") <= MAX_LIMITATIONS)
    short = first.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "error"))), lambda x: x["error"]).alias("limitations"))
    asked = requests.join(short, "request_id", "left").withColumn("limitations", F.coalesce("limitations", F.expr(EMPTY_TEXTS)))
    claims = stage(extract_claims(top, keywords))
    return EvidenceFlow(top, limits, claims, review_requests(asked, top, claims, current_year))


def rank_catalogue(requests: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """Catalogue entries per request by the number of query words their text contains, ties in catalogue order.

    A query word holds no blanks, so it is inside the text exactly when it is a substring of one of
    its tokens: distinct tokens are cut into substrings once and meet the words in an equi join.
    The first ``n`` entries enter with score 0, so short results are filled in catalogue order.
    """

    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), WS + "+"), lambda t: t != ""))

    q = requests.select("request_id", F.explode(tokens(F.col("query"))).alias("term"))
    e = entries.select("entry", "seq", F.explode(tokens(F.concat_ws(" ", "title", "snippet"))).alias("token"))
    longest = q.agg(F.max(F.length("term"))).first()[0] or 0
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("token")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.length("token") - i + 1, F.lit(longest))), lambda m: F.substr(F.col("token"), i, m)
            ),
        )
    )
    inside = e.select("token").distinct().select("token", F.explode(F.array_distinct(pieces)).alias("term"))
    words = q.select("term").distinct().join(inside, "term")
    holds = words.join(e, "token").select("term", "entry", "seq").distinct()
    hits = q.join(holds, "term")
    scored = hits.groupBy("request_id", "entry", "seq").agg(F.count("*").alias("score"))
    first = entries.orderBy("seq").limit(n).agg(F.collect_list(F.struct("entry", "seq"))).scalar()
    fill = requests.select("request_id", F.explode(first).alias("f")).select("request_id", "f.entry", "f.seq", F.lit(0).cast("long").alias("score"))
    best = scored.unionByName(fill).groupBy("request_id", "entry", "seq").agg(F.max("score").alias("score"))
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "seq")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
