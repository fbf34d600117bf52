"""URL filters by host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into all pairs of a host suffix and a path prefix of lengths that rules have; the
expressions meet the rules on a 32-bit prefix of their SHA-256 digest, full digests confirm, and the longest rule wins.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def _rest(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(n) for n in values]).cast("array<int>")


def _host_suffixes(host: Column, lengths: list[int]) -> Column:
    """The host and what follows each of its dots, where a rule's host has that length."""
    size = F.length(host)
    fits = F.filter(_numbers(lengths), lambda n: (n == size) | (n < size) & (F.substring(host, size - n, F.lit(1)) == "."))
    return F.transform(fits, lambda n: F.substring(host, size - n + 1, n))


def _path_prefixes(path: Column, closed: list[int], odd: list[int]) -> Column:
    """Prefixes that end with a slash, of the lengths ``closed``, and all prefixes of the lengths ``odd``."""
    size = F.length(path)
    slashes = F.filter(_numbers(closed), lambda n: (n <= size) & (F.substring(path, n, F.lit(1)) == "/"))
    others = F.filter(_numbers(odd), lambda n: n <= size)
    return F.array_distinct(F.transform(F.concat(slashes, others), lambda n: F.substring(path, F.lit(1), n)))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A rule (host, path, action) fits its host and all subdomains where the path starts with the rule's. The longest
    host and path together win, then the longer host, then block before allow. ``rule`` is host and path joined, null where
    none fits; ``verdict`` is then ``default``. A null url or one without "://" has empty host and path. Rules with a
    null part are ignored, repeated ones count once. Repeated pages are judged alike; an empty table gives no rows; other
    columns are ignored. Only lengths that rules have are expanded, so a url's expressions are bounded by the rules, however
    long it is; rule paths that end inside a path segment cost one more expression per distinct length.
    """
    rules = rules.select("host", "path", "action").filter("host is not null and path is not null and action is not null").distinct()
    sizes = rules.select(F.explode(F.array(
        F.struct(F.lit("host").alias("part"), F.length("host").alias("n")), F.struct(F.when(F.endswith("path", F.lit("/")), "closed").otherwise("odd").alias("part"), F.length("path").alias("n"))
    )).alias("s")).select("s.*").distinct()
    lengths: dict[str, list[int]] = {"host": [], "closed": [], "odd": []}
    for r in sizes.sort("part", "n").toLocalIterator():
        lengths[r["part"]].append(r["n"])
    digest = _expression(F.col("host"), F.col("path"))
    keyed = rules.select(digest.alias("rule_digest"), F.concat("host", "path").alias("rule"), "action", F.length("host").alias("host_len"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, 8))

    located = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    places = located.select("host", "path").distinct().filter("host <> ''")
    pairs = places.withColumn("h", F.explode(_host_suffixes(F.col("host"), lengths["host"]))).withColumn("p", F.explode(_path_prefixes(F.col("path"), lengths["closed"], lengths["odd"])))
    asked = pairs.select("host", "path", _expression(F.col("h"), F.col("p")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    hits = asked.join(keyed, "short").filter("digest = rule_digest")
    rank = F.struct(F.length("rule"), "host_len", (F.col("action") == "block").alias("b"), "rule", "action")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return located.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


SQL = r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
located as (
  select page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') as path
  from cut),
rules(rhost, rpath, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
places as (select distinct host, path from located),
best as (
  select host, path, arg_max(rhost || rpath, length(rhost) + length(rpath)) as rule, arg_max(action, length(rhost) + length(rpath)) as action
  from places join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by host, path)
select page_id, l.host, l.path, rule, coalesce(action, 'allow') as verdict
from located l left join best b on l.host = b.host and l.path = b.path
"""
