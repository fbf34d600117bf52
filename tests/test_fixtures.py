"""Literal edge rows with hand-computed expectations."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import narrative as nv
from dossier.functions import privacy as pr
from dossier.functions import reports as rp
from dossier.functions import responses as rs
from dossier.functions import text as tx
from dossier.functions import web
from dossier.operators import chunking as ch
from dossier.operators import evidence as ev
from dossier.operators import experiments as ex
from dossier.operators import feedback as fb
from dossier.operators import glyph_repair as gr
from dossier.operators import layout as ly
from dossier.operators import metrics as mt
from dossier.operators import relational as rel
from dossier.operators import retrieval as rt
from dossier.operators.scans import prefix_scan
from dossier.schemas import SECTIONS


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def sections(spark, rows):
    """rows: (seq, section, text, essentials)"""
    data = [
        (seq, "s", "ch", 0, sec, "", text, (seq, seq), len(text.split()), bool(ess), ess) for seq, sec, text, ess in rows
    ]
    return spark.createDataFrame(data, SECTIONS)


# ---- text ----


@pytest.mark.parametrize(
    "raw,slug",
    [
        ("Heart Failure", "heart_failure"), ("» Clinical  Findings", "clinical_findings"), ("  ", "unknown"), ("— ", "unknown"),
        ("Élan vital/é", "élan_vitalé"), ("a" * 50, "a" * 40), ("__x__", "x"),
    ],
)
def test_slug(spark, raw, slug):
    assert one(spark, tx.slugify(F.lit(raw))) == slug


def test_word_count_matches_python_split(spark):
    for s in ["", "  ", "a", " a b\x1cc\n\td ", "x y"]:
        assert one(spark, tx.word_count(F.lit(s))) == len(s.split())


@pytest.mark.parametrize("sizes,out", [([499, 1], [500]), ([500], [500]), ([501], [500, 1]), ([100, 1200, 50], [100, 500, 500, 200, 50]), ([300, 300], [300, 300]), ([], [])])
def test_pack(spark, sizes, out):
    segs = F.array(*[F.lit(words(n)) for n in sizes]) if sizes else F.expr("cast(array() as array<string>)")
    assert [len(t.split()) for t in one(spark, tx.pack(segs))] == out


def test_no_word_is_lost_by_packing(spark):
    text = "\n\n".join(words(n, f"p{n}x") for n in (3, 700, 40, 480, 30))
    got = one(spark, tx.split_long(F.lit(text)))
    assert " ".join(got).split() == text.split() and all(len(g.split()) <= 500 for g in got)


def test_clean_and_lines(spark):
    assert one(spark, tx.clean_chunk(F.lit("129 HEAD 1 keep\n 12 \nrest"), "\\d*\\s*HEAD 1\\s*")) == "keep\nrest"
    assert one(spark, tx.normalize_lines(F.lit("symp-\ntom  a\n\n\nb"))) == "symptom a\nb"


def test_heading_and_records(spark):
    for line, ok in [("CHEST PAIN", True), ("Chest Pain", False), ("A B C D E", False), ("TABLE X", False), ("PAIN 2", False), ("A: B", False), ("12", False)]:
        assert one(spark, tx.is_record_heading(F.lit(line))) is ok
    lines = F.array(*[F.lit(x) for x in ["before", "ONE", "TWO", "a", "", "b", "THREE"]])
    assert [tuple(r) for r in one(spark, ly.record_lines(lines, tx.is_record_heading))] == [("TWO", "a b")]


def test_natural_id(spark):
    for raw, want in [("a::b::12", ("a::b", 12)), ("a::b::x", ("a::b", 0)), ("plain", ("plain", 0)), ("a::", ("a", 0))]:
        assert tuple(one(spark, tx.natural_id_key(F.lit(raw)))) == want


# ---- chunking ----


def _merge(spark, rows, **kw):
    m = ch.forward_merge(ch.drop_empty(sections(spark, rows)), **kw).orderBy("seq").collect()
    return [(r.seq, r.section, r.text, r.merged_rows, r.essentials_text) for r in m]


def test_forward_merge_chain_border_and_tail(spark):
    long = words(60)
    rows = [(1, "A", "x y", ""), (2, "A", "z", ""), (3, "A", long, ""), (4, "A", "tail", ""), (5, "B", "b", ""), (6, "B", "", "ess"), (7, "B", "", "")]
    got = _merge(spark, rows)
    assert [g[:2] + g[3:4] for g in got] == [(3, "A", 3), (4, "A", 1), (6, "B", 2)]
    assert got[0][2] == "x y\n\nz\n\n" + long
    assert got[2][2] == "b" and got[2][4] == "ess"


def test_forward_merge_drops_or_keeps_essentials(spark):
    rows = [(1, "A", "x", "first"), (2, "A", words(60), "second")]
    assert _merge(spark, rows)[0][4] == "second"
    assert _merge(spark, rows, keep_essentials=True)[0][4] == "first\n\nsecond"


def _chunks(spark, rows):
    return [(r.chunk_id, r.subsection, r.word_count, r.text) for r in ch.structured_chunks(sections(spark, rows)).orderBy("ord").collect()]


def test_late_merge_previous_then_next(spark):
    # 510 words split into 500 + 10; the short tail returns to the previous chunk and may exceed the ceiling.
    got = _chunks(spark, [(1, "A", words(510), "")])
    assert [(g[0], g[2]) for g in got] == [("corpus::ch::a::main::1", 510)]
    # A short essentials box opens the section, so it joins the next chunk, whose id stays.
    got = _chunks(spark, [(1, "A", words(100), "box text here")])
    assert [(g[0], g[2]) for g in got] == [("corpus::ch::a::main::1", 103)]
    assert got[0][3].startswith("box text here\n\nw0")
    # Nothing to merge with: stays short.
    assert [g[2] for g in _chunks(spark, [(1, "A", "only", ""), (2, "B", words(70), "")])] == [1, 70]


def test_leading_run_that_reaches_the_minimum_stays(spark):
    rows = [(1, "A", words(70), words(49)), (2, "A", words(80), "")]
    assert [g[2] for g in _chunks(spark, rows)] == [119, 80]


def test_ids_collide_and_are_repaired(spark):
    a, b = "x" * 45 + "one", "x" * 45 + "two"
    chunks = ch.structured_chunks(sections(spark, [(1, a, words(60), ""), (2, b, words(60), "")]))
    assert chunks.select("chunk_id").distinct().count() == 1
    fixed = ch.repair_ids(chunks).orderBy("ord").collect()
    assert [r.unique_id.split("::")[-1] for r in fixed] == ["1", "1_dup2"]


def test_blocked_scan_equals_plain_window(spark):
    df = spark.range(300).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 13).alias("v"))
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.when(F.col("v") > 9, F.col("v")))}
    for exclusive in (False, True):
        small = prefix_scan(df, ["k"], "o", specs, exclusive=exclusive, block_bits=4).orderBy("o").collect()
        plain = prefix_scan(df, ["k"], "o", specs, exclusive=exclusive, single_block=True).orderBy("o").collect()
        assert small == plain


def test_sliding_windows_match_a_loop(spark):
    rows = [(i, f"S{i}", words(n, f"t{i}_"), "") for i, n in enumerate([130, 5, 700, 1, 260])]
    all_words = []
    for _, sec, text, _ in rows:
        all_words += f"[ch / {sec}]\n{text}".split()
    want = [" ".join(all_words[p : p + 200]) for p in range(0, len(all_words), 150)]
    got = ch.sliding_chunks(sections(spark, rows)).orderBy("win").collect()
    assert [g.text for g in got] == want and got[0].chunk_id == "baseline::0001"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(n,) for n in (49, 50, 100, 300, 500, 501, 1000, 1001)], "word_count int")
    got = {r.bucket: r.n for r in ch.word_count_histogram(df).collect()}
    assert got == {"<50": 1, "50-100": 1, "100-200": 1, "200-300": 0, "300-500": 2, "500-1000": 2, ">1000": 1}


# ---- layout and glyphs ----


def test_span_roles(spark):
    cases = [
        ("f1", 10.0, "x", "skip"), ("f2", 18.0, "x", "chapter_header"), ("f2", 6.0, "1", "superscript"), ("f27", 11.5, "x", "essentials_header"),
        ("f27", 9.0, "x", "essentials_body"), ("f14", 11.0, "» When", "when_to_label"), ("f2", 11.0, "x", "section_heading"), ("f14", 11.0, "x", "body"),
        ("f14", 10.0, "x", "section_heading"), ("f8", 9.0, "•", "bullet"), ("f2", 8.0, "x", "reference"), ("f16", 9.0, "x", "inline_label"), ("f2", 9.0, " ", "skip"),
    ]
    for font, size, text, role in cases:
        assert one(spark, ly.span_role(F.lit(font), F.lit(size), F.lit(text))) == role, (font, size, text)


def test_sections_from_elements(spark):
    el = [
        (0, 1, "body", 9.0, "lead"), (1, 1, "section_heading", 11.0, "Top"), (2, 2, "section_heading", 10.0, "Minor"), (3, 2, "essentials_body", 9.0, "e1"),
        (4, 2, "body", 9.0, "b1"), (5, 3, "section_heading", 10.0, "Next"), (6, 3, "reference", 8.0, "skip me"), (7, 4, "inline_label", 9.0, "b2"),
        (8, 4, "when_to_label", 11.0, "» Refer"), (9, 5, "body", 9.0, "b3"), (10, 5, "section_heading", 11.0, "Empty"),
    ]
    df = spark.createDataFrame([("C", 1, o, p, r, s, t) for o, p, r, s, t in el], "chapter string, chapter_start long, ord long, page long, role string, size double, text string")
    ends = spark.createDataFrame([("C", 9)], "chapter string, last_page long")
    got = ly.build_sections(ly.track_sections(df), ends).orderBy("seq").collect()
    assert [(g.section, g.subsection, g.text, tuple(g.page_range), g.essentials_text) for g in got] == [
        ("C", "", "lead", (1, 1), ""), ("Top", "Minor", "b1", (1, 3), "e1"), ("Top", "Next", "b2", (3, 4), ""), ("Top", "» Refer", "b3", (4, 5), ""),
    ]


def test_corrections_in_order_and_at_the_edges(spark):
    sec = spark.createDataFrame([(1, (5, 7), "aa bb", "bb"), (2, (8, 9), "aa", "")], "seq long, page_range struct<lo:long,hi:long>, text string, essentials_text string")
    cor = spark.createDataFrame([(1, 7, "aa", "bb"), (2, 7, "bb", "cc"), (3, 8, "zz", "y"), (4, 4, "aa", "q")], "corr_id long, page long, original string, corrected string")
    done = gr.apply_corrections(sec, cor)
    rows = {r.seq: (r.text, r.essentials_text, r.n_applied) for r in done.collect()}
    assert rows == {1: ("cc cc", "cc", 2), 2: ("aa", "", 0)}
    assert sorted(r.corr_id for r in gr.unmatched_corrections(cor, done).collect()) == [3, 4]


def test_solver_clear_tied_and_unsolvable(spark):
    g1, g2, g3 = "", "", ""
    texts = spark.createDataFrame([(f"h{g1}t {g1}nt c{g1}b{g1}",), (f"b{g2}t",), (f"{g3}zz{g3}",), (f"c{g1}{g2}",)], "t string")
    dic = spark.createDataFrame([(w,) for w in ("hat", "ant", "caba", "bat", "bit", "hit")], "word string")
    got = {r.glyph: (r.letter, r.uncertain) for r in gr.solve_glyphs(texts, "t", dic).collect()}
    assert got[g1] == ("a", False)
    assert got[g2][1] is True and got[g2][0] == "a"
    assert got[g3] == (None, True)


# ---- retrieval and metrics ----


def _vectors(spark, n=200, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("float32")
    x[5] = x[4]
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]], i % 3) for i in range(n)], "id long, embedding array<float>, chapter int")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("limit", [1 << 30, 8000])
def test_knn_both_paths_match_brute_force(spark, metric, limit, monkeypatch):
    x, v = _vectors(spark)
    q = v.select(F.col("id").alias("qid"), "embedding")
    got = rt.knn(v, q, 4, metric=metric, exclude_self=True, query_bytes=limit).collect()
    x = x.astype("float64")
    n = np.sqrt((x * x).sum(1))
    d = 1 - (x @ x.T) / np.outer(n, n) if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(2)
    want = set()
    for i in range(len(x)):
        order = sorted((round(float(d[i, j]), 6), j) for j in range(len(x)) if j != i)[:4]
        want |= {(i, j, r) for r, (_, j) in enumerate(order, 1)}
    assert {(r.qid, r.id, r["rank"]) for r in got} == want


def test_zero_vectors_are_ranked(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [-1.0, 0.0], 0)], "id long, embedding array<double>, chapter int")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<double>")
    for limit in (1 << 30, 1):
        got = sorted((r.qid, r["rank"], r.id, r.distance) for r in rt.knn(v, q, 3, query_bytes=limit).collect())
        assert got == [(1, 1, 1, 0.0), (1, 2, 2, 1.0), (1, 3, 3, 2.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (2, 3, 3, 1.0)]


def test_bucketed_queries_over_the_limit(spark, monkeypatch):
    _, v = _vectors(spark)
    q = v.filter("id < 20").select(F.col("id").alias("qid"), "embedding")
    b = rt.bucket_vectors(v, 4)
    want = {tuple(r) for r in rt.bucketed_knn(b, q, 5, 4, radius=1).collect()}
    monkeypatch.setattr(rt, "QUERY_BYTES", 500)
    assert len(want) >= 20 and {tuple(r) for r in rt.bucketed_knn(b, q, 5, 4, radius=1).collect()} == want


def test_bucketed_is_a_rechecked_subset(spark):
    _, v = _vectors(spark)
    q = v.filter("id < 20").select(F.col("id").alias("qid"), "embedding")
    exact = {(r.qid, r.id): r.distance for r in rt.knn(v, q, 200).collect()}
    near = rt.bucketed_knn(rt.bucket_vectors(v, 4), q, 5, 4, radius=1).collect()
    assert near and all(exact[(r.qid, r.id)] == r.distance for r in near)
    full = rt.bucketed_knn(rt.bucket_vectors(v, 4), q, 5, 4, radius=4)
    assert rt.recall_against(full, rt.knn(v, q, 5)).first().recall == 1.0


def test_encoder_failure_keeps_the_rest(spark):
    def picky(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[float(len(t))] * 2 for t in texts]

    df = spark.createDataFrame([(1, "bad")], "i long, t string").union(spark.createDataFrame([(2, "good")], "i long, t string"))
    rows = {r.id: (r.embedding, r.error) for r in rt.encode(df, "i", "t", picky, 2).collect()}
    assert rows[1][0] is None and "no" in rows[1][1] and rows[2] == ([4.0, 4.0], None)


def test_rank_metrics(spark):
    rows = [(1, 1, 1, "a", 1), (2, 3, 2, None, None), (3, 5, 5, "b", None), (4, None, 6, "c", 4), (5, None, None, None, None)]
    ranks = spark.createDataFrame(rows, "qid long, chapter_rank int, accepted_rank int, expected_section string, section_rank int")
    m = mt.hit_metrics(ranks, 5).first()
    assert (m.strict_hit1, m.strict_hit3, m.strict_hit5, m.strict_mrr) == (0.2, 0.4, 0.6, round((1 + 1 / 3 + 1 / 5) / 5, 4))
    assert (m.num_with_section, m.section_hit1, m.section_hit5, m.section_mrr) == (3, 0.3333, 0.6667, round(1.25 / 3, 4))
    labels = [one(spark, rt.status_label(F.lit(r).cast("int"), 5)) for r in (1, 3, 5, 6, None)]
    assert labels == ["HIT", "TOP3", "TOP5", "MISS", "MISS"]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 4000])
def test_order_statistics(spark, n):
    vals = [float((i * 37) % n) if n > 1 else 0.5 for i in range(n)]
    df = spark.createDataFrame([("m", v) for v in vals] + [("z", None)], "model string, latency_seconds double")
    s = sorted(vals)
    a, b = mt.latency_percentiles(df).first(), mt.latency_percentiles(df, web=True).first()
    assert (a.median_latency_s, a.p95_latency_s) == (s[n // 2], s[min(int(n * 0.95), n - 1)])
    assert b.p95_latency_s == (s[int(n * 0.95)] if n >= 20 else s[-1])


def test_order_statistics_survive_a_wrong_bracket(spark, monkeypatch):
    monkeypatch.setattr(mt, "QUANTILE_ACCURACY", 1)
    df = spark.createDataFrame([("m", float(i * i % 997)) for i in range(500)], "model string, latency_seconds double")
    s = sorted(float(i * i % 997) for i in range(500))
    r = mt.latency_percentiles(df).first()
    assert (r.median_latency_s, r.p95_latency_s) == (s[250], s[475])


def test_match_class_and_ratio(spark):
    def cls(sim, verdict):
        return one(spark, mt.match_class(F.lit(sim), F.lit(verdict).cast("string")))

    assert [cls(0.8, None), cls(0.5, "Semantic_match ok"), cls(0.7, "weird"), cls(0.6, None), cls(0.59, None)] == ["exact_match", "semantic_match", "mismatch", "partial_match", "mismatch"]
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("Acute Asthma", "asthma, acute"), ("", "")], "a string, b string")
    got = [r.v for r in df.select(mt.sequence_ratio()(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [SequenceMatcher(None, "acute asthma", "asthma, acute").ratio(), 1.0]


# ---- responses and reports ----


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"a": 1}', 1), ('x ```json\n{"a": 2}\n``` y', 2), ('<JSON>{"a": 3}</JSON>', 3), ('so {"b": {"c": 1}, "a": 4} end', 4), ("[1]", None), ("{broken", None), ("", None),
    ],
)
def test_extract_json(spark, raw, want):
    got = one(spark, rs.extract_json(F.lit(raw)))
    assert (None if got is None else json.loads(got)["a"]) == want


def test_numbered_list_and_keys(spark):
    assert one(spark, rs.numbered_list(F.lit("1. a\n3) c\nnoise\n 1. again\n9. z"), F.lit(3))) == ["again", "", "c"]
    assert one(spark, rs.missing_keys(F.lit('{"x": 1}'), ("x", "y"))) == ["y"]


def test_report_readers(spark):
    rep = "## Primary Diagnosis\n\n- Flu (confidence: high)\n\n## Clinical Reasoning\nwhy\n## Red Flags\n\nnone"
    assert one(spark, rp.primary_line(F.lit(rep))) == "Flu"
    assert one(spark, rp.primary_clean(F.lit(rep))) == "Flu"
    assert one(spark, rp.section(F.lit(rep), "Clinical Reasoning")) == "why"
    assert one(spark, rp.primary_line(F.lit("## Primary Diagnosis\n## Next\nx"))) == "## Primary Diagnosis ## Next x"
    assert one(spark, rp.primary_line(F.lit(""))) == "Unknown"
    assert one(spark, rp.primary_line(F.lit("no header\nhere"))) == "no header here"
    assert one(spark, rp.primary_clean(F.lit("nothing"))) is None
    assert [one(spark, rp.urgency_level(F.lit(u))) for u in (" High ", "low", "odd")] == ["emergency", "routine", "unknown"]
    row = spark.range(1).select(*rp.report_row(F.lit("plain"), F.lit("low"))).first()
    assert row.recommended_action == "Follow up with your healthcare provider." and row.summary_text == "plain" and row.history is None


# ---- privacy ----


@pytest.mark.parametrize(
    "raw,clean,kinds",
    [
        ("mail a.b@c.org now", "mail now", ["email"]), ("call +1 555-123-4567 ok", "call ok", ["phone_number"]), ("born dob: 1/2/1990 x", "born x", ["date_of_birth"]),
        ("seen 03/04/2020 here", "seen here", ["exact_date"]), ("MRN #AB12C now", "now", ["hospital_or_national_id"]), ("at 12 Long Hill Road today", "at today", ["address"]),
        ("my name is Jane Roe", "", ["name"]), ("a@b.co and 01/02/03 end", "and end", ["email", "exact_date"]), ("clean text", "clean text", []), (None, "", []),
    ],
)
def test_redaction(spark, raw, clean, kinds):
    df = pr.redact(spark.createDataFrame([(raw,)], "t string"), "t")
    r = df.first()
    assert (r.clean_text, r.kinds) == (clean, kinds)
    assert tuple(one(spark, pr.redact_value(F.lit(raw).cast("string")))) == (clean, kinds)
    again = pr.redact(df.select(F.col("clean_text").alias("t")), "t").first()
    assert again.clean_text == clean


def test_age_bands(spark):
    got = [one(spark, pr.age_band(F.lit(a))) for a in ("-1", "0", "12", "17", "39", "64", "65", "x")]
    assert got == [None, "infant", "child", "adolescent", "adult", "middle-aged adult", "older adult", None]


def test_query_privacy(spark):
    assert not one(spark, pr.query_is_private(F.lit("call 123-4567")))
    assert one(spark, pr.query_is_private(F.lit("guideline for asthma")))
    assert one(spark, pr.safety_penalty(F.lit("stop taking it"))) == 0.75
    assert one(spark, pr.search_string(F.array(F.lit("latest asthma (adults)")))) == "latest asthma adults guideline recommendation updated WHO CDC NICE NIH PubMed"


# ---- web evidence ----


def test_hosts_tiers_rejects(spark):
    assert one(spark, web.host(F.lit("https://WWW.Cdc.gov:80/x?y"))) == "cdc.gov:80"
    tiers = [one(spark, web.source_tier(F.lit(h))) for h in ("cdc.gov", "www2.cdc.gov", "notcdc.gov", "nejm.org", "mayoclinic.org", "x.y")]
    assert tiers == [1, 1, 99, 2, 3, 99]
    assert [one(spark, web.is_rejected(F.lit(h))) for h in ("reddit.com", "old.reddit.com", "myblog.org", "cdc.gov")] == [True, True, True, False]


def test_reliability_by_year(spark):
    def score(tier, kind, rejected, year):
        return one(spark, web.reliability(F.lit(tier), F.lit(kind), F.lit(rejected), F.lit(year).cast("int"), F.lit(0.0), 2025))

    assert [score(1, "unknown", False, y) for y in (2020, 2019, 2015, None)] == [1.0, 0.95, 0.83, 0.91]
    assert score(2, "guideline", False, 2018) == 0.9 and score(1, "guideline", True, 2024) == 0.0
    assert [one(spark, web.date_year(F.lit(x).cast("string"))) for x in ("Updated May 2013", "x12013", None)] == [2013, None, None]


def test_page_dates(spark):
    pages = [
        ('<meta name="date" content="2020-01-02T03"><meta property="article:published_time" content="2021-05-06T00:00">', "2021-05-06"),
        ('<meta content="2019-09-09x" name="dc.date">', "2019-09-09"), ('<time datetime="2018-01-01T1">x</time>', "2018-01-01"),
        ("<time> 5 May 2017 at </time>", "5 May 2017"), ("<p>none</p>", None),
    ]
    for html, want in pages:
        assert one(spark, web.page_date(F.lit(html))) == want


def test_page_text_flat_and_nested(spark):
    html = "<nav><p>menu</p></nav><h1>T &amp; x</h1><p>one <b>two</b><p>three</p><ul><li>four</ul>stray<script>var a='<p>'</script>"
    # The flat form ends a block at the next block tag only, so text after an unclosed item stays with it.
    assert one(spark, web.page_text(F.lit(html))) == "T & x one two three four stray"
    df = spark.createDataFrame([(html,)], "h string")
    nested = df.select(web.nested_page_text()(F.col("h")).alias("v")).first().v
    # The first paragraph is never closed: it holds everything after it, and its inner blocks repeat.
    assert nested == "T & x one two three four stray three four"


def _sources(spark, rows):
    return spark.createDataFrame(rows, "request_id int, source_rank int, url string, domain string, source_tier int, is_rejected boolean, year int, title string, date string, text string")


def test_claims_and_decisions(spark):
    ok = "The guideline says that adults should get the vaccine each year."
    src = _sources(
        spark,
        [
            (1, 1, "u1", "cdc.gov", 1, False, 2024, "T1", "2024", ok + " Short. " + ok.upper()), (1, 2, "u2", "bmj.com", 2, False, 2010, "T2", "2010", "Doctors do not recommend this treatment for most healthy adults."),
            (2, 1, "u3", "x.y", 99, False, None, "T3", None, "nothing"), (3, 1, "u4", "nih.gov", 1, False, 2024, "T4", "2024", "You should take 500 mg of this treatment twice every single day."),
        ],
    )
    claims = ev.extract_claims(src)
    got = [(r.request_id, r.claim_no, r.confidence) for r in claims.orderBy("request_id", "claim_no").collect()]
    assert got == [(1, 1, "high"), (1, 2, "moderate"), (3, 1, "high")]
    req = spark.createDataFrame([(i, f"q{i}", True, []) for i in (1, 2, 3, 4)] + [(5, "q5", False, [])], "request_id int, question string, deidentified boolean, limitations array<string>")
    r = {x.request_id: x for x in ev.review_requests(req, src, claims, 2025).collect()}
    assert [r[i].final_decision for i in (1, 2, 3, 4, 5)] == ["accept_with_caution", "reject", "reject", "reject", "reject"]
    assert r[1].recency_decision == "accept_with_caution" and r[1].old_sources == ["u2"] and r[1].conflicts == [ev.CONFLICT_BOTH]
    assert r[3].safety_decision == "reject" and r[2].source_decision == "reject" and r[4].summary.startswith("No reliable web evidence")
    assert "T1 (cdc.gov, updated/published 2024)" in r[1].summary


def test_final_decision_branches(spark):
    none, some = F.expr("cast(array() as array<string>)"), F.array(F.lit("c"))

    def final(deid, decisions, reliable, conflicts):
        return one(spark, ev.final_decision(F.lit(deid), [F.lit(x) for x in decisions], F.lit(reliable), conflicts))

    assert final(True, ["accept"], True, none) == "accept"
    assert final(True, ["accept"], True, some) == "accept_with_caution"
    assert final(True, ["accept_with_caution"], True, none) == "accept_with_caution"
    assert final(True, ["accept"], False, none) == "reject"
    assert final(True, ["accept", "reject"], True, none) == "reject"
    assert final(False, ["accept"], True, none) == "reject"


def test_catalogue_ranking_matches_brute_force(spark):
    entries = [(i, i, t, s) for i, (t, s) in enumerate([("Lung guideline", "care"), ("Heart", "adult care plan"), ("Skin", "x"), ("guide", "lines")])]
    e = spark.createDataFrame(entries, "entry long, seq long, title string, snippet string")
    queries = {1: "guide care", 2: "zzz", 3: "plan a skin"}
    q = spark.createDataFrame(list(queries.items()), "request_id int, query string")
    want = {}
    for rid, text in queries.items():
        terms = set(text.lower().split())
        scored = sorted(entries, key=lambda r: (-sum(t in f"{r[2]} {r[3]}".lower() for t in terms), r[1]))
        want[rid] = [r[0] for r in scored[:3]]
    got = {}
    for r in ev.rank_catalogue(q, e, 3).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.entry)
    assert got == want


def test_approach_table_golden_row(spark):
    """Twenty clean answers: five sources, four of tier 1 and one of tier 2, eight supported claims."""
    schema = (
        "approach string, valid_json boolean, latency_seconds double, final_decision string, safety_decision string, summary string, sanitized_query string, "
        "deidentified boolean, conflicts array<string>, sources array<struct<source_tier:int,domain:string>>, claims array<struct<claim:string,supporting_sources:array<string>>>, "
        "llm_failure_count int, deterministic_fallback_count int"
    )
    src = [(1, "cdc.gov")] * 4 + [(2, "idsociety.org")]
    rows = [(a, True, 0.0012, "accept_with_caution", "accept", "for physician review", "asthma", True, [], src, [("c", ["u"])] * 8, 0, 0) for a in ("hybrid_recommended", "deterministic_only") for _ in range(20)]
    t = ex.approach_metrics(spark.createDataFrame(rows, schema))
    r = t.filter("approach = 'deterministic_only'").first()
    assert (r.total_queries, r.accept_with_caution_count, r.tier1_source_percentage, r.tier2_source_percentage) == (20, 20, 80.0, 20.0)
    assert (r.source_quality_score, r.evidence_completeness_score, r.safety_score, r.privacy_score, r.overall_score) == (0.96, 1.0, 1.0, 1.0, 0.988)
    assert ex.recommended(t).first().recommended_approach == "hybrid_recommended"
    assert tuple(t.columns) == ex.RESULT_COLUMNS


# ---- feedback, lookups, narratives ----


def test_statistics_without_reviews(spark):
    r = fb.statistics(spark.createDataFrame([("pending",)], "review_status string")).first()
    assert (r.total_cases, r.pending_review, r.confirmation_rate) == (1, 1, None)


def test_reviews(spark):
    t = dt.datetime(2024, 1, 1)
    cases = spark.createDataFrame([(1, "pending", None, None, None), (2, "pending", None, None, None)], "case_id long, review_status string, doctor_decision string, doctor_diagnosis string, reviewed_at timestamp")
    rv = spark.createDataFrame([(1, 1, "Confirmed ", "", t), (2, 1, "rejected", " flu ", t), (3, 2, "rejected", " ", t)], "review_id long, case_id long, doctor_decision string, doctor_diagnosis string, reviewed_at timestamp")
    got = {r.case_id: (r.review_status, r.doctor_diagnosis) for r in fb.apply_reviews(cases, rv).collect()}
    assert got == {1: ("rejected", "flu"), 2: ("pending", None)}
    assert [r.reason for r in fb.split_reviews(rv)[1].collect()] == ["rejected without correction"]


def test_either_key_and_pending_match(spark):
    people = spark.createDataFrame([(1, 10), (2, 1)], "id long, user_id long")
    req = spark.createDataFrame([(7, 1), (8, 10), (9, 99)], "req long, ref long")
    got = {(r.req, r.id) for r in rel.match_either_key(req, people, "ref", ("id", "user_id")).collect()}
    assert got == {(7, 1), (7, 2), (8, 1)}
    f = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B")], "feedback_id long, patient_name string")
    c = spark.createDataFrame([(5, "A", "pending"), (6, "A", "confirmed"), (7, "A", "pending")], "case_id long, patient_name string, review_status string")
    assert {(r.feedback_id, r.case_id) for r in rel.match_pending_cases(f, c).collect()} == {(1, 5), (2, 7), (3, None), (4, None)}


def test_narrative_blocks(spark):
    m = F.create_map(F.lit("q"), F.lit("a"))
    assert one(spark, nv.question_answers(m)) == "  Q: q\n  A: a"
    assert one(spark, nv.question_answers(F.expr("cast(map() as map<string,string>)"))) == "  (none)"
    assert one(spark, nv.smoking_text(F.create_map(F.lit("status"), F.lit("former"), F.lit("quit"), F.lit("2001")))) == "former smoker — quit 2001"
    assert one(spark, nv.merge_answers(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def test_context_pieces_join_to_the_whole(spark):
    from dossier.operators import profiles as pf
    from dossier.plans.q_records import _updates

    u = _updates(spark, "/root/testdata/sf0.001")
    args = (pf.fold_scalars(u), pf.fold_items(u), pf.session_entries(u))
    for build in (pf.intake_context, pf.triage_context):
        texts = []
        for size in (3, 10_000):
            rows = build(*args, piece_items=size).collect()
            whole = {}
            for r in sorted(rows, key=lambda r: (r.patient, r.line_no, r.part)):
                whole[r.patient] = whole.get(r.patient, "") + r.text
            texts.append(whole)
        assert texts[0] == texts[1] and len(texts[0]) == 15


def test_scan_keeps_rows_with_null_keys(spark):
    from pyspark.sql import functions as F

    from dossier.operators.scans import prefix_scan

    rows = [(None, 0, 1), (None, 5, 2), ("a", 1, 4), ("a", 6, 8), (None, 9, 16)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for single in (False, True):
        got = prefix_scan(df, ["k"], "o", {"run": ("sum", F.col("v"))}, block_bits=40 if single else 2, single_block=single)
        assert {(r["k"], r["o"]): r["run"] for r in got.collect()} == {(None, 0): 1, (None, 5): 3, ("a", 1): 4, ("a", 6): 12, (None, 9): 19}


def test_claims_of_sources_without_text(spark):
    from dossier.operators.evidence import CLAIM_KEYWORDS, extract_claims

    said = f"This long enough sentence about the matter says that {CLAIM_KEYWORDS[0]} was clearly seen in many people."
    rows = [(1, 1, "u", 1, None, said), (2, 1, "u", 1, "", said), (3, 1, "u", 1, said, "Other."), (4, 1, "u", 1, None, None)]
    sources = spark.createDataFrame(rows, "request_id long, source_rank int, url string, source_tier int, text string, snippet string")
    assert sorted(r["request_id"] for r in extract_claims(sources).collect()) == [1, 2, 3]


# ---- scans over range partitions ----


def test_range_scan_against_plain_windows(spark):
    import random

    from dossier.operators.scans import range_scan

    rng = random.Random(3)
    rows = [(None if k == 3 else f"k{k}", f"{rng.getrandbits(60):015x}", rng.choice([None, -2, 0, 1, 5])) for k in (0, 1, 1, 1, 1, 1, 2, 3) for _ in range(90)]
    df = spark.createDataFrame(rows, "k string, id string, v long").repartition(5)
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    for exclusive in (False, True):
        state, want = {}, {}
        for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
            seen = state.setdefault(k, [])
            upto = [x for x in (seen if exclusive else [*seen, v]) if x is not None]
            want[i] = (sum(upto), max(upto, default=None), min(upto, default=None), upto[-1] if upto else None)
            seen.append(v)
        got = range_scan(df, ["k"], ["id"], specs, exclusive)
        assert got.columns == ["k", "id", "v", "s", "m", "lo", "last"]
        assert {r.id: (r.s, r.m, r.lo, r["last"]) for r in got.collect()} == want
    whole = range_scan(df, [], ["id"], {"n": ("sum", F.lit(1))}).collect()
    assert [r.n for r in sorted(whole, key=lambda r: r.id)] == list(range(1, len(rows) + 1))
    assert range_scan(df.filter("v > 9"), ["k"], ["id"], specs).count() == 0


def test_positions_past_twenty_bits_and_large_numbers(spark):
    from dossier.operators.scans import range_scan

    df = spark.range(1 << 21).select(F.lit("a").alias("k"), F.struct(F.lit(1).alias("doc"), (F.col("id") * 4097).alias("pos")).alias("ord"), (F.lit(1 << 61) - F.col("id")).alias("number"))
    out = range_scan(df, ["k"], ["ord"], {"n": ("sum", F.lit(1))})
    assert out.filter(F.col("n") != F.col("ord.pos") / 4097 + 1).isEmpty()
    back = range_scan(df, ["k"], ["number"], {"n": ("sum", F.lit(1))})
    assert back.filter(F.col("n") + F.col("ord.pos") / 4097 != 1 << 21).isEmpty()


def test_the_carry_has_one_row_per_partition(spark):
    from dossier.operators import scans

    ranged = scans.range_sort(spark.range(4000).select((F.col("id") % 900).alias("k"), "id").repartition(6), ["k"], ["id"])
    parts = ranged.select("_part").distinct().count()
    text = scans.scan_ranges(ranged, ["k"], {"n": ("sum", F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_part" in text and "Exchange hashpartitioning(k#" not in text
    assert ranged.groupBy("_part").agg(F.max_by("k", "_at")).count() == parts <= 900


def test_every_damaged_word_counts(spark):
    from dossier.plans import q_layout

    words = q_layout._flagged_words(spark, "/root/testdata/sf0.001").select("page", "word", "ord").collect()
    assert len({tuple(w.ord) for w in words}) == len(words) and max(w.ord.at for w in words) > 5


def test_page_dates_by_tags(spark):
    cases = [
        ('<meta property="date" content=""><meta name="date" content="2001-01-01"><meta name="dc.date" content="2002-02-02">', "2002-02-02"),
        ('<!-- <meta name="date" content="1999-01-01"> --><META NAME=last-modified CONTENT=2012-02-03>', "2012-02-03"),
        ("<meta name='other' content='1'><time></time>", None), ("<time datetime=''> <b>May 2013</b>, 5th</time>", "May 2013 ,"), (None, None), ("", None),
        ('<meta name="date" content="first"><meta name="date" content="second">', "first"),
    ]
    for html, want in cases:
        assert one(spark, web.page_date(F.lit(html).cast("string"))) == want


def test_evidence_flow_falls_back_and_ranks_twice(spark):
    text = "The guideline says patients should get early treatment for this."
    results = [
        ("r", 1, "https://www.cdc.gov/a", "", "Guideline a", "snip a should be long enough to be a claim here", None, "early treatment", None),
        ("r", 2, "https://x.org/b", "X.ORG", "B", "early treatment", None, "early treatment", "search_error: b"),
        ("r", 3, "https://y.org/c", "y.org", "C", "c", None, "early treatment", None),
        ("r", 4, "", "", "no url", "d", None, "early treatment", "search_error: d"),
        ("q", 1, "", None, None, None, None, None, "search_error: all"),
    ]
    fetched = [
        ("r", "https://www.cdc.gov/a", None, None, None, None, "fetch_error: a"),
        ("r", "https://x.org/b", "B early treatment", text, "early", "2024-01-01", None), ("r", "https://x.org/b", "C later", text, "early", "2024-01-01", None),
        ("r", "https://z.org/unasked", "Z", "z", "z", None, "fetch_error: z"),
    ]
    flow = ev.evidence_flow(
        spark.createDataFrame([("r", "why?", True), ("q", "what?", True), ("none", "who?", True)], "request_id string, question string, deidentified boolean"),
        spark.createDataFrame(results, "request_id string, seq long, url string, domain string, title string, snippet string, date string, query string, error string"),
        spark.createDataFrame(fetched, "request_id string, url string, title string, text string, snippet string, date string, error string"),
        2025,
    )
    top = {r.seq: r for r in flow.sources.collect()}
    assert set(top) == {1, 2, 3} and top[1].domain == "cdc.gov" and top[2].domain == "x.org"
    assert top[1].text.startswith("snip a") and top[2].text == text and top[2].title == "B early treatment" and top[3].text == "c"
    assert top[1].source_rank == 1 and top[2].source_rank == 2
    out = {r.request_id: r for r in flow.reviewed.collect()}
    assert out["r"].limitations == ["search_error: b", "search_error: d", "fetch_error: a"] and " Limitations: search_error: b; " in out["r"].summary
    assert out["q"].limitations == ["search_error: all"] and out["q"].final_decision == "reject" and out["none"].limitations == []
    assert flow.limitations.count() == 4


def test_filtered_search_reads_only_the_chapters_that_queries_name(spark, tmp_path):
    v = spark.createDataFrame([(i, f"c{i % 5}", [float(i % 7), float(i % 3), 1.0]) for i in range(200)], "id long, chapter string, embedding array<double>")
    v.write.partitionBy("chapter").parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    q = spark.createDataFrame([(1, [1.0, 0.0, 1.0], "c1"), (2, [0.0, 1.0, 1.0], "c3"), (3, [1.0, 1.0, 1.0], "c1"), (4, [1.0, 1.0, 1.0], None), (5, [1.0, 0.0, 0.0], "none")], "qid long, embedding array<double>, where string")
    for limit in (1 << 20, 30):
        got = rt.knn(stored, q, 3, where=True, query_bytes=limit)
        rows = {(r.qid, r["rank"]): (r.distance, r.id) for r in got.collect()}
        for qid, vec, chapter in ((1, (1.0, 0.0, 1.0), 1), (2, (0.0, 1.0, 1.0), 3), (3, (1.0, 1.0, 1.0), 1)):
            x = {i: (float(i % 7), float(i % 3), 1.0) for i in range(200) if i % 5 == chapter}
            cos = lambda a, b: sum(p * r for p, r in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(r * r for r in b))
            best = sorted((round(1 - cos(vec, e), 6), i) for i, e in x.items())[:3]
            assert [rows[qid, k] for k in (1, 2, 3)] == best
        assert {k[0] for k in rows} == {1, 2, 3}
    text = rt.knn(stored, q, 3, where=True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "chapter" in text.split("PartitionFilters: [")[1].split("]")[0] and "c1" in text
