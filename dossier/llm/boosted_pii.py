"""Personal data: high-recall span proposals, boosted trees on format and context, calibrated thresholds.

Four fixed patterns with their checks give the base spans, which always stay. Looser generators propose further spans, which may
overlap (addresses spelled with "at" and "dot", numbers with any separators, split or defanged IPs). Boosted trees score each
by its format and its surroundings; a kind's spans are redacted from the score on at which held-out spans of that kind were right
often enough. Everything is built-in array functions on the document's own row: texts are never shuffled.

There are no hand-labelled spans. The trees learn from base spans of a bounded sample of documents, as found and rewritten into
looser forms in their own surroundings, against wrong forms made from them and whatever else the generators propose there.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import table
from dossier.session import stage

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, in forms that need no way back: equal matches, linear time, no recursion on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What the generators propose.
_AT = r"(?:@|\[@\]|\(@\)|\[at\]|\(at\)|\x20at(?=\x20))"
_DOT = r"(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot(?=\x20))"
GENERATORS = {
    "address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]++)++",
    "dotted": r"(?<![0-9])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3,}+",
    "loose": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./:_-]{0,3}+[0-9])++",
    "tight": r"(?<![0-9A-Za-z])[0-9](?:[.-]?+[0-9])++",
}

#: What a text must hold to have a match at all: cheap to look for, and spares most texts the patterns.
_NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "address": lambda t: t.rlike(r"@|\x20at\x20|[\[(]at[\])]"),
}

PERSONAL = r"(?i)(call|phone|tel|fax|mobile|mail|contact|card|visa|account|addr|host|server|from|user)"
TECHNICAL = r"(?i)(version|\bv|order|invoice|isbn|page|vol|section|date|size|total|price|build|release|\bno\.)"

SAMPLE_DOCS = 2_000
CONTEXT = 40
ROUNDS = 10
RATE = 0.6
PRECISION = 0.98
LEAST_HELD_OUT = 20
_BLOCK = 32


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, also inside its own lambdas."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], nothing: Column) -> tuple[Column, Column]:
    """(last state, outputs) of a sequential pass over an array; ``nothing`` is an empty array of the outputs' type.

    Appending copies an array, so outputs are gathered in blocks, those in larger blocks, and only the large ones are appended to each other.
    """

    def cut(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / _BLOCK).cast("int")
        return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.slice(F.array(array), 1, 0))

    def one(acc: Column, x: Column) -> Column:
        s, out = step(acc["state"], x)
        return F.struct(s.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def over(inside: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def block(acc: Column, items: Column) -> Column:
            done = F.aggregate(items, F.struct(acc["state"].alias("state"), nothing.alias("out")), inside)
            return _bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], d["out"]).alias("out")))

        return block

    def apart(acc: Column, items: Column) -> Column:
        done = F.aggregate(items, F.struct(acc["state"].alias("state"), nothing.alias("out")), over(one))
        return _bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.slice(F.array(nothing), 1, 0).alias("out"))
    done = F.aggregate(_bound(_bound(items, cut), cut), start, apart)
    return done["state"], F.flatten(done["out"])


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds, per pattern, an array of (start, end, m, before, after) in code points; ``before`` and ``after`` reach to the next match."""
    may = {n: _NEEDS.get(n, lambda t: t.rlike("[0-9]"))(F.col("text")) for n in patterns}
    found = df.select("*", *[F.when(may[n], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{n}") for n, p in patterns.items()])
    split = found.select("*", *[F.when(F.size(f"m_{n}") > 0, F.split("text", p, -1)).alias(f"g_{n}") for n, p in patterns.items()])
    ended = split.select("*", *[_ends(n).alias(f"e_{n}") for n in patterns])
    return ended.select(*df.columns, *[_placed(n).alias(f"s_{n}") for n in patterns])


def _ends(n: str) -> Column:
    steps = F.transform(f"m_{n}", lambda m, i: F.length(m) + F.length(F.get(f"g_{n}", i)))
    _, ends = scan(steps, F.lit(0), lambda s, x: (s + x, s + x), F.array().cast("array<int>"))
    return F.when(F.size(f"m_{n}") > 0, ends)


def _placed(n: str) -> Column:
    def place(m: Column, i: Column) -> Column:
        end = F.get(f"e_{n}", i)
        gap, following = F.get(f"g_{n}", i), F.get(f"g_{n}", i + 1)
        before = F.when(F.length(gap) > CONTEXT, F.substring(gap, -CONTEXT, CONTEXT)).otherwise(gap)
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), before.alias("before"), F.substring(following, 1, CONTEXT).alias("after"))

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return F.when(F.size(f"m_{n}") > 0, F.transform(f"m_{n}", place)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits has a right check digit; false for others."""
    size = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, size - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(False)


def _small_parts(m: Column) -> Column:
    """Whether all numbers between the dots are at most 255."""
    bare = F.transform(F.split(m, r"[^0-9]+", -1), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}

_SPAN = "array<struct<start:int,rank:int,end:int,m:string,before:string,after:string>>"


def _base(df: DataFrame) -> DataFrame:
    """Adds ``base``: the valid matches of the four patterns, by start, then kind."""
    found = _with_matches(df, BASE)
    kept = [_valid_spans(r, k) for r, k in enumerate(KINDS)]
    return found.select(*df.columns, F.array_sort(F.concat(*kept)).cast(_SPAN).alias("base"))


def _valid_spans(rank: int, kind: str) -> Column:
    valid = F.filter(f"s_{kind}", lambda s: _VALID[kind](s["m"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), *[s[c].alias(c) for c in ("end", "m", "before", "after")]))


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).when(c.rlike("[-.,:;/+()@_]"), 4).otherwise(5)


#: Features of a proposal, whole numbers of a small range: name -> (span, its digits) -> value.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "kind": lambda s, d: s["rank"],
    "generator": lambda s, d: s["generator"],
    "digits": lambda s, d: F.least(F.length(d), F.lit(24)),
    "letters": lambda s, d: F.least(F.length(F.regexp_replace(s["m"], "[^A-Za-z]", "")), F.lit(24)),
    "plus": lambda s, d: F.startswith(s["m"], F.lit("+")).cast("int"),
    "round": lambda s, d: F.contains(s["m"], F.lit("(")).cast("int"),
    "square": lambda s, d: F.contains(s["m"], F.lit("[")).cast("int"),
    "at": lambda s, d: F.contains(s["m"], F.lit("@")).cast("int"),
    "spelled": lambda s, d: (F.contains(s["m"], F.lit("at")) & F.contains(s["m"], F.lit("dot"))).cast("int"),
    "dots": lambda s, d: F.least(F.regexp_count(s["m"], F.lit(r"\.")), F.lit(8)),
    "hyphens": lambda s, d: F.least(F.regexp_count(s["m"], F.lit("-")), F.lit(8)),
    "spaces": lambda s, d: F.least(F.regexp_count(s["m"], F.lit(r"\x20")), F.lit(8)),
    "marks": lambda s, d: F.least(F.regexp_count(s["m"], F.lit("[/:_]")), F.lit(8)),
    "groups": lambda s, d: F.least(F.regexp_count(s["m"], F.lit("[0-9]++")), F.lit(10)),
    "long_group": lambda s, d: F.least(F.array_max(F.transform(F.regexp_extract_all(s["m"], F.lit("[0-9]++|^"), F.lit(0)), F.length)), F.lit(24)),
    "luhn": lambda s, d: _luhn(d).cast("int"),
    "octets": lambda s, d: ((s["rank"] == KINDS.index("ip")) & _small_parts(s["m"])).cast("int"),
    "date": lambda s, d: s["m"].rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:[^0-9]|$)").cast("int"),
    "first": lambda s, d: F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)),
    "top_label": lambda s, d: F.length(F.regexp_extract(s["m"], r"([A-Za-z]{2,8})$", 1)),
    "label_case": lambda s, d: s["m"].rlike(r"[.\x20][A-Z][a-z]*$").cast("int"),
    "left": lambda s, d: _class(F.substring(s["before"], -1, 1)),
    "right": lambda s, d: _class(F.substring(s["after"], 1, 1)),
    "personal": lambda s, d: s["before"].rlike(PERSONAL).cast("int"),
    "technical": lambda s, d: s["before"].rlike(TECHNICAL).cast("int"),
}
NAMES = tuple(FEATURES)


def _proposals(df: DataFrame) -> DataFrame:
    """Adds ``proposed``: what the generators find, with kind and features, in no order and overlapping."""
    found = _with_matches(df, GENERATORS)
    email, ip, card, phone = range(4)
    rank = {"address": lambda n: F.lit(email), "dotted": lambda n: F.lit(ip), "loose": lambda n: F.when(n < 12, phone).otherwise(card), "tight": lambda n: F.when(n < 12, phone).otherwise(card)}

    def shaped(g: str, number: int) -> Column:
        numeric = F.filter(f"s_{g}", lambda s: (F.length(s["m"]) <= 200) & ((F.length(_digits(s["m"])).between(7, 19)) if g in ("loose", "tight") else F.lit(True)))
        return F.transform(
            numeric,
            lambda s: F.struct(s["start"].alias("start"), rank[g](F.length(_digits(s["m"]))).alias("rank"), *[s[c].alias(c) for c in ("end", "m", "before", "after")], F.lit(number).alias("generator")),
        )

    plain = found.select(*df.columns, F.concat(*[shaped(g, i) for i, g in enumerate(GENERATORS)]).alias("plain"))
    features = lambda s: _bound(_digits(s["m"]), lambda d: F.array(*[f(s, d).cast("int") for f in FEATURES.values()]))
    return plain.select(*df.columns, F.transform("plain", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end")], features(s).alias("f"))).alias("proposed"))


@dataclass(frozen=True)
class Tree:
    """A split on one feature with a split or a weight on either side."""

    feature: int = -1
    limit: int = 0
    low: Tree | None = None
    high: Tree | None = None
    weight: float = 0.0

    def column(self, f: Column) -> Column:
        if self.low is None:
            return F.lit(self.weight)
        return F.when(F.get(f, F.lit(self.feature)) <= self.limit, self.low.column(f)).otherwise(self.high.column(f))

    def value(self, f: list[int]) -> float:
        if self.low is None:
            return self.weight
        return (self.low if f[self.feature] <= self.limit else self.high).value(f)

    def leaf(self, f: Column, at: int = 0) -> Column:
        """A number for the leaf that a row falls into."""
        if self.low is None:
            return F.lit(at)
        return F.when(F.get(f, F.lit(self.feature)) <= self.limit, self.low.leaf(f, 2 * at)).otherwise(self.high.leaf(f, 2 * at + 1))


@dataclass(frozen=True)
class Model:
    trees: list[Tree] = field(default_factory=list)
    #: Least score per kind; a kind without one adds nothing.
    limits: dict[int, float] = field(default_factory=dict)

    def score(self, f: Column) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + t.column(f)
        return total

    def value(self, f: list[int]) -> float:
        return sum((t.value(f) for t in self.trees), 0.0)


def _best_split(cells: list) -> tuple[int, int, float, float, float] | None:
    """(feature, limit, gain, low weight, high weight) out of sums per feature and value; ties go to the first."""
    gain_of = lambda g, h: g * g / (h + 1.0)
    best = None
    for feature in sorted({c.i for c in cells}):
        rows = sorted((c for c in cells if c.i == feature), key=lambda c: c.v)
        g, h = sum(c.g for c in rows), sum(c.h for c in rows)
        left_g = left_h = 0.0
        for c, following in zip(rows, rows[1:]):
            left_g, left_h = left_g + c.g, left_h + c.h
            gain = gain_of(left_g, left_h) + gain_of(g - left_g, h - left_h) - gain_of(g, h)
            if best is None or gain > best[2] + 1e-9:
                best = (feature, (c.v + following.v) // 2 if following.v - c.v > 1 else c.v, gain, RATE * left_g / (left_h + 1.0), RATE * (g - left_g) / (h - left_h + 1.0))
    return best


def _boost(rows: DataFrame, rounds: int) -> list[Tree]:
    """Newton boosting of two-level trees. Each level is one sum per (branch, feature, value); features have few values."""
    trees: list[Tree] = []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-Model(trees).score(F.col("f"))))
        graded = rows.select("f", (F.col("n") * (F.col("label") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def sums(branch: Column) -> list:
            return graded.select(branch.alias("branch"), F.posexplode("f").alias("i", "v"), "g", "h").groupBy("branch", "i", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # noqa: B023

        top = _best_split(sums(F.lit(0)))
        if top is None:
            break
        feature, limit, _, low, high = top
        sides = [Tree(weight=low), Tree(weight=high)]
        below = sums(Tree(feature, limit, *sides).leaf(F.col("f")))
        for b in range(2):
            cut = _best_split([c for c in below if c.branch == b])
            if cut and cut[2] > 1e-6:
                sides[b] = Tree(cut[0], cut[1], Tree(weight=cut[3]), Tree(weight=cut[4]))
        trees.append(Tree(feature, limit, *sides))
    return trees


def _limits(rows: DataFrame, trees: list[Tree], precision: float) -> dict[int, float]:
    """Per kind the least score whose calibrated probability reaches ``precision`` on held-out rows: the shares of right spans per
    score, pooled so that they rise with the score."""
    cells = rows.groupBy(F.get("f", F.lit(NAMES.index("kind"))).alias("rank"), F.round(Model(trees).score(F.col("f")), 1).alias("s")).agg(F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("n")).collect()
    limits = {}
    for rank in {c["rank"] for c in cells}:
        pools: list[list[float]] = []
        for c in sorted((c for c in cells if c["rank"] == rank), key=lambda c: c.s):
            pools.append([c.s, float(c.good), float(c.n)])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, good, n = pools.pop()
                pools[-1][1] += good
                pools[-1][2] += n
        fine = [s for s, good, n in pools if good / n >= precision]
        if fine and sum(n for s, good, n in pools if s >= fine[0]) >= LEAST_HELD_OUT:
            limits[rank] = fine[0] - 0.05
    return limits


def _rewritten(s: Column) -> Column:
    """(core, label) forms of a base span: as found, in looser writing, and wrong ones made from it."""
    m, d = s["m"], _digits(s["m"])
    pair = lambda c, ok: F.struct(c.alias("core"), F.lit(ok).alias("good"))
    cut = lambda a, b: F.substring(d, a, b)
    fours = lambda sep: F.concat_ws(sep, cut(1, 4), cut(5, 4), cut(9, 4), F.substring(d, 13, 7))
    last = F.right(d, F.lit(10))
    tens = lambda sep: F.concat_ws(sep, F.substring(last, 1, 3), F.substring(last, 4, 3), F.substring(last, 7, 4))
    wrong = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 3) % 10).cast("string"))
    date = F.concat(F.lit("20"), cut(1, 2), F.lit("-0"), cut(3, 1), F.lit("-1"), cut(4, 1), F.lit(" 1"), cut(5, 1), F.lit(":2"), cut(6, 1), F.lit(":3"), cut(7, 1))
    forms = {
        "email": [pair(m, 1), pair(F.replace(F.replace(m, F.lit("."), F.lit(" dot ")), F.lit("@"), F.lit(" at ")), 1), pair(F.replace(F.replace(m, F.lit("."), F.lit("[dot]")), F.lit("@"), F.lit("[at]")), 1), pair(F.replace(m, F.lit("."), F.lit("[.]")), 1), pair(F.concat(F.regexp_replace(m, "[^a-z].*", ""), F.lit(" at "), F.regexp_replace(m, "^.*@|[.].*", ""), F.lit(". The")), 0)],
        "ip": [pair(m, 1), pair(F.replace(m, F.lit("."), F.lit("[.]")), 1), pair(F.regexp_replace(m, "[0-9]+$", "731"), 0), pair(F.concat(m, F.lit(".7")), 0), pair(F.concat(F.regexp_extract(m, "^[0-9]+[.][0-9]+", 0), F.lit(".2")), 0)],
        "card": [pair(m, 1), pair(fours(" "), 1), pair(fours("."), 1), pair(fours("/"), 1), pair(wrong, 0), pair(F.regexp_replace(wrong, "^(.{4})(.{4})(.{4})", "$1.$2.$3."), 0), pair(F.substring(d, 1, 9), 0), pair(F.substring(wrong, 2, 14), 0)],
        "phone": [pair(m, 1), pair(tens("-"), 1), pair(tens("."), 1), pair(F.concat(F.lit("("), F.substring(last, 1, 3), F.lit(") "), F.substring(last, 4, 3), F.lit("-"), F.substring(last, 7, 4)), 1), pair(date, 0), pair(F.substring(date, 1, 10), 0), pair(F.concat(cut(1, 5), F.lit(" "), cut(6, 4)), 0), pair(last, 0)],
    }
    choice = F.when(s["rank"] == 0, F.array(*forms["email"]))
    for r, k in list(enumerate(KINDS))[1:]:
        choice = choice.when(s["rank"] == r, F.array(*forms[k]))
    return choice


def _sample(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(h, text) of the ``size`` different texts with the smallest hashes among those that may hold a span."""
    may = docs.select(F.col(text).cast("string").alias("text")).filter(F.col("text").rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9]{4}")).withColumn("h", F.xxhash64("text"))
    cut = may.select("h").distinct().orderBy("h").limit(size).agg(F.max("h").alias("h")).first().h
    return may.filter(F.col("h") <= F.lit(cut).cast("long")).groupBy("h").agg(F.min("text").alias("text"))


def training_rows(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(f, label, held_out, n): feature arrays of proposals in a sample, right or wrong, and how often each occurs."""
    sample = stage(_sample(docs, text, sample_docs))
    held = (F.pmod(F.xxhash64("h", F.lit("fold")), F.lit(3)) == 0).alias("held_out")
    based = stage(_base(sample))
    # explode_outer: a plain explode would push a test of the array, and with it all that makes the array, below every step.
    spans = based.select("h", F.explode_outer("base").alias("s")).filter(F.length("s.m") <= 100)
    written = spans.select("h", F.col("s.rank").alias("want"), F.col("s.before").alias("before"), F.col("s.after").alias("after"), F.explode_outer(_rewritten(F.col("s"))).alias("w"))
    texts = written.select("h", "want", F.length("before").alias("at"), F.length("w.core").alias("long"), F.col("w.good").alias("good"), F.concat("before", "w.core", "after").alias("text"))
    tried = _proposals(texts).select("h", "want", "at", "long", "good", F.explode_outer("proposed").alias("p")).filter((F.col("p.start") < F.col("at") + F.col("long")) & (F.col("p.end") > F.col("at")))
    exact = (F.col("p.start") == F.col("at")) & (F.col("p.end") == F.col("at") + F.col("long")) & (F.col("p.rank") == F.col("want"))
    made = tried.select(F.col("p.f").alias("f"), F.when(exact, F.col("good")).otherwise(0).alias("label"), held)
    others = _select(_proposals(based).withColumn("proposed", F.transform("proposed", lambda p: p.withField("score", F.lit(0.0)))), best=False)
    natural = others.select("h", F.explode_outer("added").alias("p")).filter("p is not null").select(F.col("p.f").alias("f"), F.lit(0).alias("label"), held)
    return made.unionByName(natural).groupBy("f", "label", "held_out").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, precision: float = PRECISION) -> Model:
    """Trees and thresholds from at most ``sample_docs`` different texts, two thirds to fit, one third to calibrate.

    Without base spans in the sample, as in an empty table, the model adds nothing.
    """
    rows = stage(training_rows(docs, text, sample_docs).coalesce(1))
    if rows.filter("label = 1 and not held_out").isEmpty():
        return Model()
    trees = _boost(rows.filter("not held_out"), rounds)
    return Model(trees, _limits(rows.filter("held_out"), trees, precision))


def _select(df: DataFrame, best: bool = True) -> DataFrame:
    """Adds ``added``: proposals that touch no base span; with ``best`` the highest scored of each run of overlapping ones."""
    span = lambda s, is_new, f, score: F.struct(s["start"].alias("start"), F.lit(is_new).alias("new"), s["end"].alias("end"), s["rank"].alias("rank"), score.alias("score"), f.alias("f"))
    flat = F.array_sort(F.concat(F.transform("base", lambda s: span(s, 0, F.slice(F.array(F.lit(0)), 1, 0), F.lit(0.0))), F.transform("proposed", lambda s: span(s, 1, s["f"], s["score"]))))
    merged = df.withColumn("merged", F.when(F.size("proposed") > 0, flat))
    kind = "struct<start:int,new:int,end:int,rank:int,score:double,f:array<int>>"
    none = lambda: F.array().cast(f"array<{kind}>")
    missing = lambda: F.lit(None).cast(kind)
    _, ahead = scan(
        F.coalesce("merged", none()), F.lit(0),
        lambda end, x: (F.when(x["new"] == 0, F.greatest(end, x["end"])).otherwise(end), F.when((x["new"] == 0) | (end <= x["start"]), x)), none(),
    )
    forward = merged.withColumn("merged", F.when(F.size("proposed") > 0, F.reverse(F.filter(ahead, lambda x: x.isNotNull()))))
    far = 2**31 - 1
    _, behind = scan(
        F.coalesce("merged", none()), F.lit(far),
        lambda start, x: (F.when(x["new"] == 0, F.least(start, x["start"])).otherwise(start), F.when((x["new"] == 1) & (start >= x["end"]), x)), none(),
    )
    free = forward.withColumn("merged", F.when(F.size("proposed") > 0, F.reverse(F.filter(behind, lambda x: x.isNotNull()))))
    if not best:
        return free.select(*df.columns, F.coalesce("merged", none()).alias("added"))

    def run(state: Column, x: Column) -> tuple[Column, Column]:
        apart = state["end"] <= x["start"]
        longer = x["end"] - x["start"] > state["best"]["end"] - state["best"]["start"]
        better = (x["score"] > state["best"]["score"]) | ((x["score"] == state["best"]["score"]) & longer)
        held = F.when(state["best"].isNull() | apart | better, x).otherwise(state["best"])
        return F.struct(F.greatest(state["end"], x["end"]).alias("end"), held.alias("best")), F.when(apart, state["best"])

    last, out = scan(F.coalesce("merged", none()), F.struct(F.lit(0).alias("end"), missing().alias("best")), run, none())
    chosen = F.filter(F.concat(out, F.array(last["best"])), lambda x: x.isNotNull())
    return free.select(*df.columns, F.when(F.size(F.coalesce("merged", none())) > 0, chosen).otherwise(none()).alias("added"))


def find_private(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``pii``: a struct of ``base`` and ``added`` spans (start, rank, end), each by start, then kind.

    Places are in code points, ends exclusive; ``rank`` counts in KINDS. Null texts are empty and have no spans. Repeated rows are rows each.
    A column of the caller named ``pii`` is replaced; other names do not matter. Texts may be of any length.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    based = _base(held)
    if model.limits:
        limit = lambda rank: F.coalesce(*[F.when(rank == r, F.lit(v)) for r, v in model.limits.items()], F.lit(math.inf))
        scored = _proposals(based).withColumn("proposed", F.transform("proposed", lambda p: p.withField("score", model.score(p["f"]))))
        added = _select(scored.withColumn("proposed", F.filter("proposed", lambda p: p["score"] >= limit(p["rank"]))))
    else:
        added = based.withColumn("added", F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    narrow = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    pii = F.struct(narrow("base").alias("base"), narrow("added").alias("added")).alias("pii")
    return added.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "pii"], pii)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(pii: Column) -> Column:
    return F.array_sort(F.concat(pii["base"], pii["added"]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of the first one's kind in square brackets."""
    size = 4096
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(low: Column, high: Column) -> Column:
        i, j = F.floor(low / size).cast("int"), F.floor(high / size).cast("int")
        at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        inside = F.substr(at(i), low % size + 1, high - low)
        across = F.concat(F.substr(at(i), low % size + 1, F.lit(size)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(at(j), F.lit(1), high % size))
        return F.when(high <= low, "").when(i == j, inside).otherwise(across)

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        out = F.when(s["start"] < end, "").otherwise(F.concat(piece(end, s["start"]), F.get(names, s["rank"])))
        return F.greatest(end, s["end"]), out

    end, parts = scan(spans, F.lit(0), step, F.array().cast("array<string>"))
    return F.concat(F.array_join(parts, ""), piece(end, F.length(text)))


def _count(rank: int) -> Column:
    return F.size(F.filter("pii.base", lambda s: s["rank"] == rank)).cast("long")


def op11_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs.select("doc_id", "text"), fit(docs))
    counts = [_count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("pii.base")), 256).alias("base_sha256"), listed(all_spans(F.col("pii"))).alias("spans"))
