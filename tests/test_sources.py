"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from dossier.operators.retrieval import encode, hashed_words, upsert
from dossier.sources import readers as rd
from dossier.sources import writers as wr


def test_records_lines_and_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "p"}, {"x": 2}]))
    assert [tuple(r) for r in rd.read_records(spark, str(tmp_path / "a.json"), "x int, y string").collect()] == [(1, "p"), (2, None)]
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\n  \n{broken\n{"x": 3}\n')
    good, bad = rd.read_json_lines(spark, str(tmp_path / "l.jsonl"), "x int")
    assert sorted(r.x for r in good.collect()) == [1, 3] and [r.raw for r in bad.collect()] == ["{broken"]
    d = tmp_path / "docs"
    d.mkdir()
    (d / "b.json").write_text(json.dumps({"x": 2}, indent=2))
    (d / "c.json").write_text("{nope")
    (d / "training_data.jsonl").write_text('{"x": 9}')
    assert [(r.file_name, r.x) for r in rd.read_document_folder(spark, str(d), "x int").collect()] == [("b.json", 2)]


def test_word_list_and_cases(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Apple\n apple \nab\n\n")
    assert [r.word for r in rd.read_word_list(spark, str(tmp_path / "w.txt"), 3).collect()] == ["apple"]
    raw = spark.createDataFrame([(1, "", "cp", None, "fd", "ch"), (2, "pp", "cp", "gt", "fd", "")], "case_idx int, patient_presentation string, case_prompt string, ground_truth_diagnosis string, final_diagnosis string, chapter string")
    assert [tuple(r) for r in rd.case_fields(raw).orderBy("case_idx").collect()] == [(1, "cp", "fd", "ch"), (2, "pp", "gt", None)]
    assert rd.case_fields(raw, 1).count() == 1


def test_error_records_and_training(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"k":1}'), ("b", None)], "symptom string, j string")
    wr.write_parsed(df, "symptom", "j", str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ['{"k":1}', '{"symptom":"b","error":"parsing_failed"}']
    cases = spark.createDataFrame(
        [("1", "p", "pending", None, None, "r0"), ("2", "p", "confirmed", "confirmed", None, "r1"), ("3", "p", "rejected", "rejected", "dx", "r2"), ("4", "p", "rejected", "rejected", "", "r3")],
        "case_id string, patient_name string, review_status string, doctor_decision string, doctor_diagnosis string, report string",
    ).withColumn("urgency", F.lit("low")).withColumn("system_primary_diagnosis", F.lit("s"))
    wr.write_training_data(cases, str(tmp_path / "t"))
    got = {j["case_id"]: (j["expected_output"], j["was_correct"]) for j in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "t")).collect())}
    assert got == {"2": ("r1", True), "3": ("dx", False), "4": ("r3", False)}


def test_embeddings_store_and_count(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string")
    path = str(tmp_path / "e")
    wr.write_embeddings(encode(docs, "id", "t", hashed_words(8), 8), path, "hashed", 8, "none", "2024-01-01")
    meta = spark.read.json(f"{path}/metadata").first()
    assert (meta["count"], meta.failed, meta.dim) == (2, 0, 8)
    v = spark.read.parquet(f"{path}/vectors").withColumn("chapter", F.lit("c"))
    store = str(tmp_path / "s")
    wr.write_store(v, store)
    wr.write_store(v.limit(1), store)
    assert tuple(wr.check_count(spark, store, 3).first()) == (3, 2, "FAIL", 1, 0)
    wr.write_store(v.limit(1), store, force=True)
    assert wr.check_count(spark, store, 1).first().status == "PASS"


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k long, v string")
    new = spark.createDataFrame([(2, "n1", 1), (2, "n2", 2), (3, "n", 1)], "k long, v string, at long")
    assert sorted(map(tuple, upsert(old, new, "k", "at").collect())) == [(1, "o"), (2, "n2"), (3, "n")]
