"""Quality classes, mixing and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dossier.llm import ordinal_quality, partenum, soft_mixing
from dossier.llm.hashed_text import WordFeatures, features, labelled_sample


def made_rows(n, seed):
    """Texts whose marker words give the grade away, in many filler words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 200)))]
        for m in ([f"vile{x}" for x in rng.integers(0, 5, 4)], [f"junk{x}" for x in rng.integers(0, 5, 6)], [])[grade]:
            words.insert(int(rng.integers(0, len(words))), m)
        rows.append((i, " ".join(words), int(grade != 1), int(grade == 0)))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    frame = spark.createDataFrame(made_rows(1600, 4), "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text").cache(), frame.select("doc_id", "quality", "toxic").cache()


def test_grades_on_held_out_rows(made):
    docs, labels = made
    model = ordinal_quality.fit(docs, labels, fold=0)
    assert (np.diff(model.cuts) > 0).all()
    held = ordinal_quality.score(docs, model).join(labels.withColumn("want", ordinal_quality.graded(labels)), "doc_id").filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 1).toPandas()
    assert len(held) > 500
    assert (held.p_above_0 >= held.p_above_1).all() and np.allclose(held.grade, held.p_above_0 + held.p_above_1)
    assert (np.round(held.grade) == held.want).mean() > 0.85
    assert held[held.want == 2].kept.mean() > 0.95 and held[held.want < 2].kept.mean() < 0.1


def test_ordinal_gradient():
    """The fitted likelihood is near a stationary point: no single-feature step improves it much."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    y = np.digitize(x + 0.5 * rng.logistic(size=400), [-1, 1])
    model = ordinal_quality.fit_rows(y, np.arange(401), np.full(400, 7), x, 3)
    assert model.weights[7] > 1 and model.cuts[0] < 0 < model.cuts[1]


def test_scores_of_edges(spark, made, edge_docs, no_docs):
    docs, labels = made
    model = ordinal_quality.fit(docs, labels)
    rows = ordinal_quality.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(r["grade"] is not None and r["kept"] is not None for r in rows)
    blank = {r["grade"] for r in rows if r["doc_id"] in (0, 1, 2)}
    assert len(blank) == 1
    kept = ordinal_quality.keep_good(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert ordinal_quality.score(no_docs, model).count() == ordinal_quality.keep_good(no_docs, model).count() == 0
    nothing = ordinal_quality.fit(docs, labels.limit(0))
    assert ordinal_quality.score(docs, nothing).filter("not kept").count() == 0
    missing = labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert ordinal_quality.score(docs, ordinal_quality.fit(docs, missing)).filter("not kept").count() == 0


def test_sample_is_bounded_and_apart(made):
    docs, labels = made
    grade = ordinal_quality.graded(labels)
    assert labelled_sample(docs, labels, grade, rows=50).count() == 50
    both = labelled_sample(docs, labels, grade, fold=0).count() + labelled_sample(docs, labels, grade, fold=1).count()
    assert both == docs.count()


def test_features_of_long_and_blank_texts(monkeypatch):
    from dossier.llm import hashed_text

    texts = [None, "", "a b a", " ".join(f"x{i}" for i in range(900))]
    whole = features(texts, WordFeatures())
    monkeypatch.setattr(hashed_text, "WORD_CACHE", 100)
    cut = features(texts, WordFeatures())
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert whole[3].tolist() == [0, 0, 3, 900]


def posterior_rows(spark, n=3000, seed=6):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.6, 0.3, 0.3], n)
    rows = [(i, i, int(t), q.tolist()) for i, (t, q) in enumerate(zip(rng.integers(0, 2000, n), p, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, th long, n_tokens long, p array<double>")


@pytest.mark.parametrize("weights", [(0.85, 0.10, 0.05), (0.2, 0.2, 0.6), (1.0, 1.0, 1.0)])
def test_rates_reach_the_targets(spark, weights):
    table = posterior_rows(spark).cache()
    mix = soft_mixing.fit_rates(table, weights)
    rated = table.withColumn("rate", soft_mixing.rate_of(mix.gradients, 3)).toPandas()
    p = np.stack(rated.p.to_list())
    reached = (rated.rate.to_numpy() * rated.n_tokens.to_numpy())[:, None] * p
    target = np.array(weights) / sum(weights) * rated.n_tokens.sum()
    assert (rated.rate >= 0).all() and np.allclose(reached.sum(0), target, rtol=1e-4)
    copies = soft_mixing.decide(table, mix, 1).toPandas()
    assert ((copies.copies - copies.rate).abs() < 1).all() and abs(copies.copies.sum() / copies.rate.sum() - 1) < 0.05


def test_targets_out_of_reach(spark):
    """No row is pure: a share of 1 for one domain can't be met; rates stay valid and the fit gets nearer than the start."""
    table = posterior_rows(spark, 300).cache()
    mix = soft_mixing.fit_rates(table, (1.0, 0.0, 0.0))
    start = soft_mixing.fit_rates(table, (1.0, 0.0, 0.0), steps=0)
    off = lambda m: sum(abs(a - b) for a, b in zip(m.reached, m.target, strict=True))
    assert off(mix) < 0.5 * off(start)
    assert table.select(soft_mixing.rate_of(mix.gradients, 3).alias("r")).filter("r < 0 or isnan(r)").count() == 0


def test_mix_of_edges(spark, made, edge_docs, no_docs):
    docs, labels = made
    rows = soft_mixing.mix(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(r["rate"] >= 0 and r["copies"] >= 0 for r in rows)
    assert all(abs(r["p_clean"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    assert soft_mixing.mix(no_docs, labels).count() == 0
    kept = soft_mixing.thin(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    assert soft_mixing.thin(no_docs, labels).count() == 0
    assert soft_mixing.mix(docs, labels.limit(0)).count() == docs.count()


def test_labels_without_documents_take_no_place(spark, made):
    docs, labels = made
    strange = spark.range(100_000, 140_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    held = labelled_sample(docs, labels.union(strange), ordinal_quality.graded(labels), rows=500)
    assert held.count() == 500


def test_thinning_of_filtered_rows(spark, made):
    """What a filter has left of the poor and toxic text is found by a model of the whole table, and the shares fall."""
    docs, labels = made
    rows = docs.join(labels, "doc_id").withColumn("bad", F.expr("quality = 0 or toxic = 1")).withColumn("copy", F.expr("doc_id + 1000000"))
    left = rows.filter("not bad").select("doc_id", "text").union(rows.filter("bad and doc_id % 20 = 0").select("copy", "text")).cache()
    bad = left.filter("doc_id >= 1000000").count()
    kept = soft_mixing.thin(left, labels, labelled=docs).cache()
    assert bad >= 30 and kept.filter("doc_id >= 1000000").count() <= 0.7 * bad
    assert kept.filter("doc_id < 1000000").count() >= 0.98 * left.filter("doc_id < 1000000").count()
    model = soft_mixing.fit(docs, labels)
    before, after = (soft_mixing.shares(soft_mixing.posteriors(t, model)) for t in (left, kept))
    assert after[1] < before[1] and after[2] < before[2] and abs(sum(after) - 1) < 1e-9


def test_pipeline_stages(spark):
    """Each stage against a plain version on what its predecessor kept."""
    import corpus_pipeline as pipeline
    from llm.test_pairs import brute_components

    from dossier.llm.common import table
    from dossier.session import stage

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    columns = docs.columns
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality", "exact_copies", "near_copies", "mixing", "encoding"]

    good = stage(steps["quality"](spark, docs, SF))
    want = {r["doc_id"] for r in ordinal_quality.score(docs, ordinal_quality.fit(docs, labels)).filter("kept").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == want
    graded = good.join(labels, "doc_id")
    bad = labels.filter("quality = 0 or toxic = 1").join(docs, "doc_id")
    assert graded.filter("quality = 0 or toxic = 1").count() <= 0.6 * bad.count()
    clean = labels.filter("quality = 1 and toxic = 0").join(docs, "doc_id")
    assert graded.filter("quality = 1 and toxic = 0").count() >= 0.95 * clean.count()

    single = stage(steps["exact_copies"](spark, good, SF))
    texts = {}
    for r in good.collect():
        texts[r["text"]] = max(texts.get(r["text"], -1), r["doc_id"])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(texts.values())

    apart = stage(steps["near_copies"](spark, single, SF))
    groups = brute_components([(r["doc_id"], r["text"]) for r in single.collect()])
    assert apart.columns == columns and sorted(r["doc_id"] for r in apart.collect()) == sorted({c for _, c in groups.values()})

    mixed = stage(steps["mixing"](spark, apart, SF))
    assert mixed.columns == columns and set(map(tuple, mixed.collect())) <= set(map(tuple, apart.collect()))
    assert mixed.count() >= 0.9 * apart.count()

    encoded = steps["encoding"](spark, mixed, SF)
    assert Counter(r["doc_id"] for r in encoded.collect()) == {r["doc_id"]: 2 for r in mixed.collect()}
    assert pipeline.run(spark, SF).count() == encoded.count()
    assert partenum.jaccard_components(mixed).filter("doc_id <> component_id").count() == 0
