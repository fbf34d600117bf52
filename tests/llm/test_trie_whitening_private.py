"""The trie, the whitening and the personal-data spans against plain versions of themselves."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import boosted_pii, prefix_trie, whitening
from dossier.llm.queries import op11_boosted_pii

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie -------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    plain = {c: [(t[1], t[3]) for t in sorted(ts, key=lambda t: t[:3])] for c, ts in turns.items()}
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        rebuilt[c] = tuple(plain.get(base, [])[:h] + plain[c][h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in members if rebuilt[c] == p))
        saved = sum((len(nodes[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def trie_table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, digest string").repartition(parts)


ODD_CONVERSATIONS = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}  words\t\v here") for c in range(0, 65) for t in range(c % 6)]
    + [(c, t, "user", "same") for c in range(100, 140) for t in range(5)]
    + [(7, None, None, None), (7, None, "user", ""), (None, 1, "user", "nobody"), (12, 3, "user", "twice"), (12, 3, "user", "twice")]
    + [(-1, 0, "user", "below"), (-20, 0, "user", "zero"), (-20, 1, "user", "one"), (-21, 5, None, "é 　 日本")]
)


def test_trie_against_a_plain_one(spark):
    got = prefix_trie.prefix_trie(trie_table(spark, ODD_CONVERSATIONS))
    assert got.count() == len(plain_trie(ODD_CONVERSATIONS)) and trie_rows(got) == plain_trie(ODD_CONVERSATIONS)


def test_trie_with_one_conversation_over_many_partitions(spark):
    rows = [(40, t, "user", f"w{t % 7}") for t in range(900)] + [(41, t, "user", f"w{t % 7}") for t in range(700)] + [(60, 1, "a", "b")]
    got = trie_rows(prefix_trie.prefix_trie(trie_table(spark, rows, 1)))
    small = [r for r in rows if r[1] < 60]
    assert len(got) == len({x for x in got}) and trie_rows(prefix_trie.prefix_trie(trie_table(spark, small))) == plain_trie(small)
    assert max(r[1] for r in got) == 900 and sum(r[3] for r in got if r[1] == 0) == 3


def test_trie_id_blocks_are_chained(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(100, 160)]
    assert trie_rows(prefix_trie.prefix_trie(trie_table(spark, rows))) == plain_trie(rows)


def test_trie_starts_again_after_a_false_meeting(spark, monkeypatch):
    right = prefix_trie._bases
    monkeypatch.setattr(prefix_trie, "_bases", lambda seed: [1] * prefix_trie.LANES if seed == 0 else right(seed))
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (0, 2, "u", "c"), (1, 0, "u", "b"), (1, 1, "u", "a"), (1, 2, "u", "c"), (1, 3, "u", "d"), (2, 0, "u", "x")]
    assert trie_rows(prefix_trie.prefix_trie(trie_table(spark, rows))) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(trie_table(spark, [(None, 1, "u", "x")])).count() == 0


# --- whitening ---------------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, components=8):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, vecs = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    return [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x], y @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    deviations, expected, explained = plain_whitening([r.embedding for r in rows])
    got = whitening.whiten(table).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    w *= np.sign((w * expected).sum(axis=0))
    assert np.abs(w - expected).max() < 1e-9
    assert got.groupby("vec_id").deviation.first().sort_index().tolist() == deviations
    first = got[got.vec_id == rows[0].vec_id].sort_values("component")
    assert np.allclose(first.explained, explained, rtol=1e-9) and (got.identity_error < 1e-9).all() and (got.n == len(rows)).all()


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=3)], 1) for i in range(30)]
    odd = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [1.0, float("nan"), 2.0], 1), (93, [float("inf"), 0.0, 0.0], 1), (94, [], 1), (95, [1.0], 1), (96, [1e300, 0.0, 0.0], 1), (5, rows[5][1], 2), (None, rows[6][1], 2)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows + odd], "vec_id long, embedding array<double>, label int, x string, component string")
    got = whitening.whiten(df).collect()
    assert len(got) == 32 * 3 and {r.vec_id for r in got} == {r[0] for r in rows} | {None}
    deviations, _, _ = plain_whitening([r[1] for r in rows] + [rows[5][1], rows[6][1]])
    assert {r.deviation for r in got if r.vec_id == 0} == {deviations[0]}
    assert whitening.whiten(df.filter("vec_id = 1")).count() == whitening.whiten(df.filter("vec_id < -1")).count() == 0
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_a_deviation_past_64_bits_is_null(spark):
    df = spark.createDataFrame([(i, [1e9 * i, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in whitening.whiten(df).filter("vec_id in (0, 39)").collect())


@pytest.mark.parametrize(
    "values",
    [
        np.r_[np.full(20, 5.0), 5 + 1e-9 * np.arange(20), np.linspace(1, 2, 20)],
        np.ones(60),
        np.r_[np.zeros(30), np.linspace(1, 3, 30)],
        np.geomspace(1e-12, 1, 60),
        np.r_[3 + 1e-6 * np.arange(30), np.linspace(0, 1, 30)],
    ],
)
def test_refinement_of_clustered_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(60, 60)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.refined_eigenvectors(a)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(60)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * got).max() < 1e-14


# --- personal data -----------------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain_base(text):
    found = []
    for rank, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (True, rank != 1 or all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)
            if checks[rank]:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


ODD_TEXTS = [
    None, "", "a@b.c.@d.e x_y@z", "a@b.c_d@e.f", "😀 me@x.org 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (988) 555-2485 +12 +1+1+1 +123456789012345678", "9 " * 4000, "1" * 3000, "a@" * 2000, "a@b.co " * 3000, "." * 2000 + "@", "+1" + "(" * 2000,
    "x" * 3000, "1.1.1.1 " * 3000, "٣@x.y ١.2.3.4", "mail me: a.b%c+d-e@f-g.h-i.j, card 30569309025904.",
]


@pytest.fixture(scope="module")
def odd_texts(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, row string, base string, proposed string").repartition(8)


def test_base_spans_against_plain_patterns(odd_texts):
    got = {r.doc_id: [(s.start, s.rank, s.end) for s in r.pii.base] for r in boosted_pii.find_private(odd_texts, boosted_pii.Model()).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(ODD_TEXTS)}


def test_long_runs_take_linear_time(spark):
    texts = ["1" * 1_000_000, "a@" * 300_000, "." * 1_000_000 + "@", "+1" + "(" * 1_000_000, "x" * 1_000_000, "9 " * 300_000, "a. b. " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert all(r.pii.base == [] for r in boosted_pii.find_private(df, boosted_pii.Model()).collect())


@pytest.fixture(scope="module")
def private_model(spark):
    return boosted_pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_added_spans(spark, private_model):
    cards = "4465758382889437 4465758382889437"
    texts = ["thation " + cards + " ógaja", "shin 4465 7583 8288 9437 and", "released 2024-05-01 10:22:33 in version 4.12.3", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in boosted_pii.find_private(df, private_model).select("doc_id", "pii", boosted_pii.redacted(F.col("text"), boosted_pii.all_spans(F.col("pii"))).alias("clean")).collect()}
    assert [(s.start, s.end) for s in out[0].pii.added] == [(8, 24), (25, 41)] and out[0].clean == "thation [CARD] [CARD] ógaja"
    assert out[1].clean == "shin [CARD] and" and not out[1].pii.added
    assert out[2].clean == texts[2] and out[3].clean == texts[3]


def test_scores_and_choice_against_plain_code(spark, sf, private_model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    based = boosted_pii.stage(boosted_pii._proposals(boosted_pii._base(docs)))
    found = {r.doc_id: r.pii for r in boosted_pii.find_private(docs, private_model).collect()}
    for r in based.collect():
        base = [(s.start, s.end) for s in r.base]
        fine = []
        for p in r.proposed:
            score = private_model.value(p.f)
            if score >= private_model.limits.get(p["rank"], np.inf) and not any(a < p.end and p.start < b for a, b in base):
                fine.append((p.start, p.end, p["rank"], score))
        runs = []
        for p in sorted(fine):
            if runs and p[0] < runs[-1][0]:
                runs[-1] = (max(runs[-1][0], p[1]), [*runs[-1][1], p])
            else:
                runs.append((p[1], [p]))
        best = [max(run, key=lambda p: (p[3], p[1] - p[0])) for _, run in runs]
        assert {(s.start, s.end) for s in found[r.doc_id].added} == {(p[0], p[1]) for p in best}


def test_query_counts_and_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_boosted_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        line = ",".join(f"{boosted_pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_without_spans_the_model_adds_nothing(spark, no_docs):
    model = boosted_pii.fit(no_docs)
    assert not model.trees and boosted_pii.find_private(no_docs, model).count() == 0


def test_redaction_of_long_texts(spark):
    text = "é" * 5000 + " me@x.org " + "b" * 9000 + "1.2.3.4"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = boosted_pii.find_private(df, boosted_pii.Model()).select(boosted_pii.redacted(F.col("text"), F.col("pii.base")).alias("r")).first().r
    assert out == text.replace("me@x.org", "[EMAIL]").replace("1.2.3.4", "[IP]")
