"""Operators that judge or rewrite single rows: URL rules, WARC derivatives, secrets, token counts, sampled pieces."""

import gzip
import hashlib
import json
import random
import re
import time
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dossier.llm import chunk_tokens, sampled_pieces, secret_owners, url_rules, warc_derivatives


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


URLS = [
    "http://com/", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://example.com", "ftp://a.b.net/es/", "http://net/fr/", "http://net/fr",
    "http://xexample.com/en/", "nonsense", "", None, "http://", "http:///en/", "http://a.com?u=http://example.com/en/", "http://example.com/en", "http://example.com/en//a/../b",
    "x://y.org/en/://example.com/en/", "http://example.com./en/", "http://..com/", "http://" + "a." * 200 + "com/" + "p/" * 300, "http://example.com/enter", "http://É.example.com/en/é",
]


@pytest.mark.parametrize("more", [(), (("example.com", "/en", "allow"), ("example.com", "", "block"), ("example.com", "/en/x", "allow"), ("com", "/ent", "block"), (None, "/", "block"), ("com", "/", "allow"))])
def test_url_rules(spark, more):
    rules = [*url_rules.RULES, *more]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, short string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()}
    known = [r for r in rules if None not in r]
    assert got == {i: plain_verdict(u, known) for i, u in enumerate(URLS * 2)}
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, url_rules.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_very_long_urls(spark):
    """Hosts and paths of a million characters: expressions follow the rules, not the url."""
    long = [(1, "http://www.example.com/en/" + "a/" * 500_000), (2, "http://" + "a." * 500_000 + "example.com/en/x"), (3, "http://net/fr/" + "b" * 1_000_000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(long, "page_id long, url string"), url_rules.rule_table(spark)).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("net/fr/", "block")}


def test_url_rules_stay_in_the_engine(spark):
    plan = url_rules.judge(spark.read.parquet(f"{SF}/pages.parquet"), url_rules.rule_table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    assert "html" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_warc_edges(spark, tmp_path):
    html = "<html><title> A\n b </title><script>x<1</script><p>one &amp;lt; two</p><!-- no --><a href='u'>link</a><A HREF=v>w</A></html>"
    rows = [(1, "http://a/\r\nX: 1", html), (2, None, None), (3, "", ""), (1, "http://a/\r\nX: 1", html), (None, "http://c/", "<p>" + "long text " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("x"))
    got = warc_derivatives.derivatives(warc_derivatives.responses_from_pages(pages))
    records = got.collect()
    assert len(records) == 10 and Counter(r["warc_type"] for r in records) == {"metadata": 5, "conversion": 5}
    one = next(r for r in records if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert one["block"] == "A\nb\none &lt; two\nlink w" and one["content_length"] == len(one["block"])
    assert one["target_uri"] == "http://a/ X: 1"
    meta = next(r for r in records if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert meta["refers_to"] == one["refers_to"] and "outlinks: 2\r\n" in meta["block"] and "source-header: HTTP/1.1 200 OK\r\n" in meta["block"]
    assert meta["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert all(r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() for r in records)
    assert next(r for r in records if r["page_id"] == 2 and r["warc_type"] == "conversion")["block"] == ""
    assert warc_derivatives.derivatives(warc_derivatives.responses_from_pages(pages.limit(0))).count() == 0
    warc_derivatives.write_warc(got, str(tmp_path / "w"))
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("*.gz"))
    read, at = [], 0
    while at < len(raw):
        head, body = raw[at:].split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        read.append(body[:size])
        assert body[size : size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
    assert sorted(read) == sorted(r["block"].encode() for r in records)


#: Opened and never closed marks, alone, before and after closed ones.
OPEN_MARKS = ("<", "<!--", "<script>", "<style ", "<title>", "<title", "<br ", "</script ", "<a ", "&lt;", "<!-- > ", "<script></style>")


def plain_page(html):
    t = re.sub(r"(?s)<!--.*?-->", " ", html)
    t = re.sub(r"(?is)<script\b.*?</script\s*>", " ", t)
    t = re.sub(r"(?is)<style\b.*?</style\s*>", " ", t)
    t = re.sub(r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/title|/section|/article|/ul|/ol|/table)\b[^>]*>", "\n", t)
    t = re.sub(r"<[^>]*>", " ", t)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = t.replace(name, char)
    t = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", t)).strip(" \n")
    title = re.search(r"(?is)<title[^>]*>(.*?)</title", html)
    links = len(re.findall(r"(?i)<a\s[^>]*href\s*=", html))
    return t, re.sub(r"[ \t\r\n\f]+", " ", title[1]).strip(" ") if title else "", links


def test_pages_with_marks_left_open(spark):
    rng = random.Random(4)
    parts = [*OPEN_MARKS, "-->", ">", "</script>", "</STYLE >", "</title>", "</p>", "href =", "<A\n", "href", "x", " é ", "\n"]
    html = [m * 3 for m in OPEN_MARKS] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(html)), "i long, h string")
    shown = frame.select("i", warc_derivatives.plain_text(F.col("h")), warc_derivatives.title_of(F.col("h")), warc_derivatives.n_links_of(F.col("h")))
    got = {r[0]: tuple(r)[1:] for r in shown.collect()}
    assert got == {i: plain_page(h) for i, h in enumerate(html)}


def test_broken_pages_take_linear_time(spark):
    html = [m * (1_000_000 // len(m)) for m in OPEN_MARKS]
    frame = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("http://a/"))
    began = time.monotonic()
    assert warc_derivatives.derivatives(warc_derivatives.responses_from_pages(frame)).agg(F.sum(F.length("record"))).first()[0] > 0
    assert time.monotonic() - began < 120


PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
)


def plain_spans(text):
    out = []
    for k, (name, p, least) in enumerate(PATTERNS):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}", m[0]) for m in p.finditer(text or "") if len(m[2] if name == "assign" else m[0]) >= least]
    return sorted(out)


KEY = "Abc9Zq7Lw2Pk5Rt8Vn3Xm6Hs1Jd4Fg"
SECRET_ROWS = [
    (1, "PassWord: 'abc123' and token=xx and api_key = zzzzzz", "o1", "r1"), (2, "AKIA" + "A" * 20 + " AKIAAKIA x", "o2", "r1"), (3, "AKIA" + "A" * 20, "o3", "r2"), (4, "AKIA" + "A" * 20, "o4", "r2"),
    (5, "secret=" + "0a" * 14, "o1", "r1"), (6, "é\U0001f600 secret=" + "0a" * 14, "o1", "r3"), (7, f"key {KEY} end", "o1", "r1"), (8, f"{KEY}, {KEY}", "o1", "r2"), (9, "K" + KEY, "o1", "r1"), (10, "K" + KEY, "o2", "r1"),
    (11, None, None, None), (12, "", "o1", None), (13, "PAſSWORD=abcdefg toKen=abcdefg", "o1", "r"), (14, "x" * 100_000 + " token=" + "a" * 1000, None, None), (5, "secret=" + "0a" * 14, "o1", "r1"), (None, "token=abcdef", "o9", "r9"), (15, f"token={KEY}", "o1", "r5"), (16, "f" * 23 + "g" + "f" * 24, "o5", "r5"),
]


def test_secrets(spark):
    docs = spark.createDataFrame(SECRET_ROWS, "doc_id long, text string, o string, r string").selectExpr("*", "'x' as spans", "'y' as hash", "'z' as owner").repartition(4)
    rows = secret_owners.find_secrets(docs, F.col("o"), F.col("r")).collect()
    assert len(rows) == len(SECRET_ROWS)
    texts = {i: t for i, t, *_ in SECRET_ROWS}
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(s[2] for s in base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        assert {s[2] for s in base} <= set(filter(None, r["spans"].split(",")))
        assert r["n_example"] + r["n_owned"] + r["n_shared"] == len(base)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_example"] == by[3]["n_example"] == 1 and by[1]["n_owned"] == 2 and by[5]["n_owned"] == 2
    assert "opaque" in by[7]["spans"] and by[8]["spans"].count("opaque") == 2 and "opaque" not in by[9]["spans"] + by[15]["spans"]
    assert by[11]["spans"] == "" and by[11]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_owners.find_secrets(docs.limit(0), F.col("o"), F.col("r")).count() == 0


def test_opaque_spans_in_one_sweep():
    """Against all pairs on mixed texts, and 10^5 spans of both sorts in little time."""
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice([f"token={KEY} ", f"{KEY} ", f"{KEY}{'0a' * 14} ", "0a" * 14 + " ", "secret: ", "AKIA" + "B" * 20, "- "]) for _ in range(12))
        base = secret_owners.base_spans(text)
        want = [(m.start(), m.end()) for m in secret_owners.OPAQUE.finditer(text) if all(p.search(m[0]) for p in secret_owners.OPAQUE_PARTS) and all(m.end() <= s or m.start() >= e for s, _, e, _ in base)]
        assert [(s, e) for s, _, e, _ in secret_owners.opaque_spans(text, base)] == want
    text = f"token={KEY} {KEY} " * 50_000
    began = time.monotonic()
    assert len(secret_owners.opaque_spans(text, secret_owners.base_spans(text))) == 50_000
    assert time.monotonic() - began < 10


def test_every_opaque_span_has_a_class(spark):
    long = KEY * 6
    rows = [(1, f"a {KEY}", "o1"), (2, f"b {KEY} {long}", "o2"), (3, f"c {'Q' + KEY}", "o1"), (4, f"{'R' + KEY}", "o1"), (5, f"{'R' + KEY}", "o2"), (6, f"{'R' + KEY}", "o3"), (7, "none", "o1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o string")
    got = {r["doc_id"]: (r["opaque_spans"], r["spans"]) for r in secret_owners.find_secrets(docs, F.col("o"), F.lit("r")).collect()}
    n, m = len(KEY), len(long)
    assert m > 128 and got[1] == (f"shared:2:{2 + n}", "") and got[2] == (f"shared:2:{2 + n},owned:{3 + n}:{3 + n + m}", f"opaque:{3 + n}:{3 + n + m}")
    assert got[3] == (f"owned:2:{3 + n}", f"opaque:2:{3 + n}") and got[7] == ("", "")
    assert all(got[i] == (f"example:0:{1 + n}", "") for i in (4, 5, 6))


def test_ownership_counts(spark):
    rows = [("a", "o1", "r1"), ("a", "o1", "r1"), ("a", "o1", "r2"), ("a", "o2", "r1"), ("b", None, None), ("b", None, None)]
    got = {r["hash"]: (r["n_repositories"], r["n_owners"]) for r in secret_owners.ownership(spark.createDataFrame(rows, "hash string, owner string, repository string")).collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}


HARD = [
    "<|endoftext|>" * 300 + "abc " * 100, "x" * 5000, " " * 3000 + "y", "é" * 2000 + "<|endoftext|>" + "\n\n \n" * 500, "", None, "a'b\n\n  c" * 400, "<|endoftext|>ab" * 400, "日本語テキスト" * 600, "123 456\t\t " * 300,
    "\U0001f600\u0301 " * 500, "don't we'll  I'M" * 200, "\x00\x01 \u00a0\u2003x" * 300, "a", "<|endoftext" * 200,
]


@pytest.mark.parametrize("chunk,overlap", [(100, 20), (64, 32), (1000, 100), (32_768, 512)])
def test_token_counts(spark, bpe_file, chunk, overlap):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_file)
    docs = spark.createDataFrame([(i, x, "k") for i, x in enumerate(HARD)] * 2 + [(None, HARD[0], "k")], "doc_id long, text string, key string").repartition(3)
    rows = chunk_tokens.token_counts(docs, bpe_file, chunk=chunk, overlap=overlap).collect()
    assert len(rows) == 2 * len(HARD) + 1
    for r in rows:
        text = (HARD[0] if r["doc_id"] is None else HARD[r["doc_id"]]) or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)
    assert chunk_tokens.token_counts(docs.limit(0), bpe_file).count() == 0


def test_token_counts_of_documents(documents, bpe_file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_file)
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False)) for r in documents.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in chunk_tokens.token_counts(documents, bpe_file, chunk=500, overlap=40).collect()} == want


def test_units_count_as_the_library_does(bpe_file):
    """Every cut begins a word; a unit that is remembered is not encoded again."""
    t, counts, rng = chunk_tokens.tokenizer(bpe_file), chunk_tokens.UnitCounts(bpe_file), random.Random(5)
    bits = [*" \t\n\r\x0b\x1c\x85\xa0\u2003\u3000\u200bab's\u00e9\u01311\u0663,.;:!?<|>\u037e\u0436\u4e2d\u0301\U0001f642", "  ", " a", "'ll", "3.14", "<|endoftext|>", " <|endoftext|> ", "e.g., "]
    texts = [*(x or "" for x in HARD), *("".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(20_000))]
    assert chunk_tokens.cuts_in_units(bpe_file)
    assert all("".join(chunk_tokens.UNIT.findall(x)) == x for x in texts)
    want = [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 1000):
        assert counts.of(texts[start : start + 1000]) == want[start : start + 1000]
    assert max(map(len, counts)) <= chunk_tokens.UNIT_CHARS and len(counts) <= chunk_tokens.UNITS_KEPT

    seen = []

    class Watched:
        def encode_batch_fast(self, units, **how):
            seen.extend(units)
            return t.encode_batch_fast(units, **how)

    counts.tokenizer = Watched()
    counts.clear()
    assert counts.of(["the sea, the sea."] * 50) == counts.of(["the sea, the sea."] * 50) == [6] * 50
    assert sorted(seen) == [" sea", " the", ",", ".", "the"]


def test_units_are_forgotten_when_there_are_too_many(bpe_file, monkeypatch):
    monkeypatch.setattr(chunk_tokens, "UNITS_KEPT", 10)
    t, counts = chunk_tokens.tokenizer(bpe_file), chunk_tokens.UnitCounts(bpe_file)
    for text in [" ".join(f"w{i}" for i in range(n, n + 6)) for n in range(0, 60, 3)]:
        assert counts.of([text]) == [len(t.encode(text, add_special_tokens=False))] and len(counts) <= 10


@pytest.mark.parametrize(
    "change",
    [
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None},
        {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 50256, "content": "a b", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
    ],
)
def test_other_tokenizers_get_whole_texts(spark, bpe_file, tmp_path, change):
    from tokenizers import Tokenizer

    path = str(tmp_path / "other.json")
    with open(bpe_file, encoding="utf-8") as f, open(path, "w", encoding="utf-8") as g:
        json.dump(json.load(f) | change, g)
    t, texts = Tokenizer.from_file(path), ["a b  c, a\tb", " e\u0301a b", "b. a b a"]
    assert not chunk_tokens.cuts_in_units(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in chunk_tokens.token_counts(docs, path).collect()} == {i: len(t.encode(x, add_special_tokens=False)) for i, x in enumerate(texts)}


def all_segmentations(v, text):
    shown = sampled_pieces.SPACE + text.replace(" ", sampled_pieces.SPACE)
    ids = {v.texts[i]: i for i in np.flatnonzero(v.weight)}

    def rest(p):
        if p == len(shown):
            yield (), 0.0
            return
        for k in range(1, v.longest + 1):
            if p + k <= len(shown) and shown[p : p + k] in ids:
                i = ids[shown[p : p + k]]
                for s, w in rest(p + k):
                    yield (i, *s), w + v.weight[i]
        if shown[p] not in ids:
            for s, w in rest(p + 1):
                yield (*v.bytes[list(shown[p].encode())].tolist(), *s), w + 4 * v.weight.min()

    out = dict(rest(0))
    z = np.log(sum(np.exp(w) for w in out.values()))
    return {s: w - z for s, w in out.items()}


def test_samples_follow_the_distribution(pieces_file):
    """Distinct samples with the right log-probabilities; inclusion frequencies as those of Gumbel top-k over the listed space; inverse inclusion weights add up to one."""
    k, n, text = 3, 3000, "the cat\nis é"
    sampler = sampled_pieces.Sampler(pieces_file, 0.2, k, 5)
    space = all_segmentations(sampler.v, text)
    keys = sampled_pieces.mix64(np.arange(n, dtype=np.uint64))
    rows = defaultdict(list)
    for low in range(0, n, 500):
        for i, rank, path, lp, g, q in sampler.run([text] * 500, keys[low : low + 500]):
            ids = tuple(sampler.ids(path, text).tolist())
            assert abs(space[ids] - lp) < 1e-6 and rank == len(rows[low + i])
            rows[low + i].append((ids, g, q))
    assert all(len({x[0] for x in r}) == k and r[0][1] >= r[1][1] >= r[2][1] for r in rows.values())
    names = list(space)
    g = np.array([space[s] for s in names]) + np.random.default_rng(0).gumbel(size=(20_000, len(names)))
    want = np.bincount(np.argsort(-g, axis=1)[:, :k].ravel(), minlength=len(names)) / 20_000
    times = Counter(x[0] for r in rows.values() for x in r)
    assert max(abs(times[s] / n - w) for s, w in zip(names, want, strict=True)) < 0.035
    assert abs(sum(np.exp(space[s] - q) for r in rows.values() for s, _, q in r) / n - 1) < 0.05


def test_small_spaces_are_exhausted(pieces_file):
    sampler = sampled_pieces.Sampler(pieces_file, 0.2, 9, 5)
    rows = list(sampler.run(["a", "  ", "日"], sampled_pieces.mix64(np.arange(3, dtype=np.uint64))))
    for i, text in enumerate(["a", "  ", "日"]):
        assert {tuple(sampler.ids(p, text).tolist()) for j, _, p, *_ in rows if j == i} == set(list(all_segmentations(sampler.v, text)))
    assert all(q == 0.0 for *_, q in rows)


def test_round_trip_and_edges(spark, edge_docs, no_docs, documents, pieces_file):
    for docs in (edge_docs, documents):
        encoded = sampled_pieces.sample_segmentations(docs, pieces_file, samples=3)
        rows = sampled_pieces.decode(encoded, pieces_file).collect()
        texts = defaultdict(set)
        for r in docs.select("doc_id", "text").collect():
            texts[r["doc_id"]].add((r["text"] or "").replace("▁", " "))
        assert {r["doc_id"] for r in rows} == set(texts)
        assert all(r["text"] in texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in rows)
    again = sampled_pieces.sample_segmentations(documents.repartition(5), pieces_file, samples=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, sampled_pieces.sample_segmentations(documents.coalesce(1), pieces_file, samples=3).collect()))
    assert sampled_pieces.sample_segmentations(no_docs, pieces_file).count() == 0


@pytest.mark.parametrize("name", ["op2_url_rules", "op3_partenum", "op4_warc_derivatives", "op6_tree_forest", "op10_golomb_dedup"])
def test_queries_against_sql(spark, name):
    from dossier.llm.queries import LLM_QUERIES, LLM_SQL

    assert compare.diff(LLM_QUERIES[name](spark, SF), compare.connect(SF), LLM_SQL[name])[0] is None


def test_small_slices_and_caches_give_equal_samples(documents, pieces_file):
    few = sampled_pieces.sample_segmentations(documents, pieces_file, slice_bytes=1 << 12, node_cache=1 << 10)
    plain = sampled_pieces.sample_segmentations(documents, pieces_file)
    rows = lambda df: {(r.doc_id, r["sample"]): (tuple(r.ids), round(r.log_prob, 9), round(r.perturbed, 9), round(r.log_inclusion, 9)) for r in df.collect()}
    assert rows(few) == rows(plain)
