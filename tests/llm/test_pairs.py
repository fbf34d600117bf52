"""Exact copies, near copies and near vectors against brute force."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dossier.llm import golomb_dedup, partenum, tree_forest
from dossier.llm.common import probably_in
from dossier.llm.components import connected_components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width=5):
    words = text.encode().lower().split() if text else []
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    union = Union([i for i, _ in sets])
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets}


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 700)]
    mesh = [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (90, 2))]
    edges = chain + star + mesh + [(7, 7), (8, 9), (9, 8)]
    union = Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    roots = {}
    for r in got:
        assert roots.setdefault(union.find(r["node"]), r["root"]) == r["root"]
    assert len(set(roots.values())) == len(roots)
    assert {r["node"] for r in got} == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_keeps_all_members(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = {r["id"] for r in probably_in(spark.range(5000), __import__("pyspark.sql.functions", fromlist=["col"]).col("id"), keys).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 900
    assert probably_in(spark.range(9), __import__("pyspark.sql.functions", fromlist=["col"]).col("id"), keys.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.75, 0.5, 0.9])
def test_signatures_meet(threshold):
    """Random pairs at or above the threshold always share a signature, also the small and the barely similar ones."""
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 2**64, 2 * n + 2, dtype=np.uint64)
        shared = base[:n]
        extra = int(n / threshold - n + 1e-9)
        left = int(rng.integers(0, extra + 1))
        x, y = np.sort(np.concatenate((shared, base[n : n + left]))), np.sort(np.concatenate((shared, base[n + left : n + extra])))
        sides = [partenum.signatures(s, threshold) for s in (x, y)]
        shared = set(sides[0][0]) & set(sides[1][0])
        assert shared, (n, left, extra)
        bands = [partenum.band_limits(len(s), threshold)[0] for s in (x, y)]
        for (_, _, sure), own in zip(sides, bands, strict=True):
            assert len(shared) >= sure[max(bands) - own]


def test_sketches_are_lower_bounds():
    rng = np.random.default_rng(5)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**64, int(rng.integers(2, 900)), dtype=np.uint64))
        x, y = (np.sort(rng.choice(base, int(rng.integers(1, len(base))), replace=False)) for _ in "ab")
        assert partenum.sketch_distance(partenum.odd_sketch(x), partenum.odd_sketch(y)) <= len(np.setxor1d(x, y))
        assert partenum.sketch_distance(partenum.odd_sketch(x), partenum.odd_sketch(x)) == 0


def test_jaccard_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = partenum.jaccard_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_jaccard_group_that_no_leader_holds(spark):
    """A row of texts, each similar to the next only: one component through links that the leader does not have."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)] + [(100 + i, " ".join(words[8 * i : 8 * i + 100])) for i in range(0, 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    assert {c for _, c in got.values()} == {0}


def test_jaccard_with_crowded_lists(spark):
    """A passage in very many texts, small and large near copies among them: no link gets lost when sets leave crowded lists."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = [f"u{x}" for x in rng.integers(0, 10**6, int(rng.integers(10, 150)))]
        text = words + passage
        rows.append((10 * i, " ".join(text)))
        for j in range(int(rng.integers(0, 3))):
            text = list(text)
            text[int(rng.integers(0, len(text)))] = f"x{i}{j}"
            rows.append((10 * i + j + 1, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark, edge_docs, no_docs):
    rows = partenum.jaccard_components(edge_docs).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert got[(0, 0, 0)] == got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 1, 3)] == got[(4, 1, 4)] == 1
    assert got[(5, 2, 5)] == 2 and got[(6, 2, 5)] == got[(7, 2, 5)] == 1
    assert got[(9, 1, 9)] == 1 and got[(None, 0, None)] == 1 and got[(None, 2, None)] == 1
    assert partenum.jaccard_components(no_docs).count() == 0
    kept = partenum.keep_representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 5, 8, 9, 10]


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_golomb_round_trip(n):
    values = np.sort(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    assert (golomb_dedup.golomb_decode(golomb_dedup.golomb_encode(values)) == values).all()
    close = np.arange(n, dtype=np.uint64) // np.uint64(2)
    assert (golomb_dedup.golomb_decode(golomb_dedup.golomb_encode(close)) == close).all()


def test_exact_edges(spark, edge_docs, no_docs):
    rows = golomb_dedup.exact_groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    for group in by.values():
        ids = [r["doc_id"] for r in group]
        top = max((i for i in ids if i is not None), default=None)
        assert all(r["keep_id"] == top and r["group_size"] == len(group) for r in group)
        assert sum(r["kept"] for r in group) == 1 and next(r["doc_id"] for r in group if r["kept"]) == top
    assert sorted(map(len, by.values()))[-2:] == [3, 3]
    kept = golomb_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(by)
    assert golomb_dedup.exact_groups(no_docs).count() == 0 and golomb_dedup.drop_copies(no_docs).count() == 0


def test_repeated_rows_become_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a c"), (2, "a c"), (None, "d"), (None, "d")], "doc_id long, text string").repartition(4)
    got = sorted(golomb_dedup.drop_copies(docs).collect(), key=repr)
    assert [tuple(r) for r in got] == [(1, "a b"), (2, "a c"), (None, "d")]


def brute_vectors(rows):
    union, links = Union([i for i, *_ in rows]), Counter()
    for k, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:k]:
            if la == lb and la is not None and x is not None and y is not None and len(x) == len(y) and None not in x and None not in y:
                u, v = np.array(x, float), np.array(y, float)
                size = np.linalg.norm(u) * np.linalg.norm(v)
                if np.isfinite(size) and size > 0 and u @ v / size >= 0.98:
                    union.join(a, b)
                    links.update([a, b])
    return {i: (links[i], union.find(i), union.find(i) == i) for i, *_ in rows}


def vector_rows(n, dim=16, seed=2):
    """A dense cluster that no cut separates, spread vectors, a hot label, copies, and unusable rows."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dim)
    rows = []
    for i in range(n):
        v = centre + 0.02 * rng.standard_normal(dim) if i % 3 == 0 else rng.standard_normal(dim)
        if i % 10 == 7:
            v = np.array(rows[-1][1]) + 0.03 * rng.standard_normal(dim)
        rows.append((i, v.astype(np.float32).tolist(), 1 if i % 3 else i % 2))
    rows += [(n, rows[3][1], rows[3][2]), (n + 1, [0.0] * dim, 1), (n + 2, None, 1), (n + 3, rows[3][1], None), (n + 4, [float("nan")] * dim, 1), (n + 5, [1.0, None], 1), (n + 6, [float("inf")] * dim, 1), (n + 7, [], 1)]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vector_rows(1500)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as node", "'y' as cid", "1 as many")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in tree_forest.near_duplicates(frame).collect()}
    expected = brute_vectors(rows)
    assert got.keys() == expected.keys()
    found, there = sum(g[0] for g in got.values()), sum(e[0] for e in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert found >= 0.95 * there > 10_000
    assert all(got[i] == expected[i] for i in range(1501, 1508))


def test_double_vectors_of_any_size(spark):
    """Cosines in double precision where the parts, or their squares, are no floats; decimals become doubles."""
    near = [1.0, 0.2030, 0.0]
    rows = [(1, [1e-60, 0.0, 0.0], 1), (2, [2e-60, 0.0, 0.0], 1), (3, [1e40, 0.0, 0.0], 1), (4, [2e200, 0.0, 0.0], 1), (5, [1e-310, 0.0, 0.0], 1), (6, [0.0, 1e300, 1e300], 1), (7, near, 2), (8, [1.0, 0.0, 0.0], 2), (9, [1.0, 0.2031, 0.0], 2)]
    assert 1 / np.hypot(1, 0.2030) >= 0.98 > 1 / np.hypot(1, 0.2031)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in tree_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (0, 6), 7: (2, 7), 8: (1, 7), 9: (1, 7)}
    exact = spark.createDataFrame(rows[6:], "vec_id long, embedding array<double>, label int").withColumn("embedding", F.col("embedding").cast("array<decimal(12,6)>"))
    assert {r["vec_id"]: r["n_links"] for r in tree_forest.near_duplicates(exact).collect()} == {7: 2, 8: 1, 9: 1}


def test_vectors_in_blocks(spark, monkeypatch):
    """Leaves larger than a block are cut; nothing is lost or counted twice."""
    monkeypatch.setattr(tree_forest, "LEAF", 40)
    rows = vector_rows(400)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = tree_forest.near_duplicates(frame, trees=3).collect()
    expected = brute_vectors(rows)
    assert all(r["n_links"] <= expected[r["vec_id"]][0] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.95 * sum(e[0] for e in expected.values())
    assert tree_forest.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [40, 70_000])
def test_blocks_hold_no_index_per_signature(most):
    """A block comes back as it was and takes little more than 6 bytes a signature (an index made it 8 and more)."""
    rng = np.random.default_rng(3)
    many = np.append(rng.integers(20, 40, 50), most)
    index = np.repeat(np.arange(len(many)), many)
    sigs, upper = rng.integers(0, 1 << 48, len(index)).astype(np.uint64), rng.integers(0, 2, len(index)).astype(bool)
    owner = rng.integers(0, 2, len(index))
    ids, sizes = rng.integers(0, 1 << 60, len(many)).astype(np.uint64), rng.integers(1, 999, len(many)).astype(np.uint32)
    for o, block in partenum._pack(sigs, upper, owner, index, ids, sizes):
        s, local, i, z, u = partenum._unpack(memoryview(block))
        mine = owner == o
        assert (s == sigs[mine]).all() and (i[local] == ids[index[mine]]).all() and (z[local] == sizes[index[mine]]).all() and (u == upper[mine]).all()
        assert len(block) < 7.6 * mine.sum()
