"""Streaming forms against their batch counterparts."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.operators import sessions as batch
from dossier.plans import adapters
from dossier.sources.readers import read_table
from dossier.streaming import sessions as live
from dossier.streaming import upserts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _feed(spark, tmp_path, df, files=3):
    """Parquet files in the order of the first column, read back as a stream with one file per micro-batch."""
    src = str(tmp_path / "in")
    first = df.columns[0]
    cuts = [r[1] for r in df.select(F.ntile(files).over(Window.orderBy(first)).alias("n"), first).groupBy("n").agg(F.max(first)).orderBy("n").collect()]
    low = None
    for i, high in enumerate(cuts):
        part = df.filter(F.col(first) <= high) if low is None else df.filter((F.col(first) > low) & (F.col(first) <= high))
        part.coalesce(1).write.parquet(f"{src}/b{i}")
        low = high
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(src)


def _run(query_df, tmp_path, mode, name):
    spark = query_df.sparkSession
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def test_gap_of_exactly_the_ttl_continues(spark, tmp_path):
    rows = [(1, _at(0)), (1, _at(30)), (1, _at(60, 1)), (2, _at(5))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = {(r.user_id, r.events) for r in batch.expire_sessions(df).collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}


def test_stream_sessions_equal_batch(spark, sf, tmp_path):
    e = read_table(spark, sf, "events").select("ts", "user_id")
    last = e.agg(F.max("ts")).first()[0]
    flush = spark.createDataFrame([(last + dt.timedelta(days=1), -1), (last + dt.timedelta(days=2), -2)], e.schema)
    out = _run(live.expire_sessions(_feed(spark, tmp_path, e.unionByName(flush))), tmp_path, "append", "closed").filter("user_id >= 0")
    want = batch.expire_sessions(e)
    cols = ["user_id", "session_start", "last_active", "events"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "user_id long, ts timestamp"
    for i, rows in enumerate([[(1, _at(0))], [(1, _at(600))], [(9, _at(601))], [(1, _at(10))], [(2, _at(2000))], [(3, _at(4000))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={i}")
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(src).drop("part")
    out = _run(live.expire_sessions(stream), tmp_path, "append", "late").collect()
    assert sorted((r.user_id, r.events) for r in out) == [(1, 1), (1, 1), (2, 1), (9, 1)]


def test_running_state_and_phases(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    m = adapters.messages(spark, sf)
    rows = m.select("turn", "session_id", "urgency", F.col("message_type").alias("flag"), (F.col("sender") == "user").alias("answered"))
    out = _run(live.running_state(_feed(spark, tmp_path, rows)), tmp_path, "update", "state")
    final = out.groupBy("session_id").agg(F.max_by(F.struct("urgency", "flags", "answered"), "answered").alias("s"))
    want = batch.session_state(rows).select("session_id", F.array_join("flags", ",").alias("flags"), "answered", "urgency")
    got = {r.session_id: (r.s.answered,) for r in final.collect()}
    assert got == {r.session_id: (r.answered,) for r in want.collect()}
    top = {"routine": 0, "urgent": 1, "emergency": 2}
    best = {}
    for r in out.collect():
        best[r.session_id] = max(best.get(r.session_id, 0), top[r.urgency])
    assert best == {r.session_id: top[r.urgency] for r in want.collect()}


def test_phase_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    m = adapters.messages(spark, sf).select("turn", "session_id", F.col("message_type").alias("phase"))
    out = _run(live.phase_changes(_feed(spark, tmp_path, m)), tmp_path, "append", "phases")
    want = batch.phase_changes(m).select("session_id", "turn", "from_phase", "phase")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_profile_stream_equals_batch(spark, sf, tmp_path):
    from dossier.operators import profiles
    from dossier.plans.q_records import _updates

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    u = _updates(spark, sf)
    flat = u.select("ord", "patient", F.col("demographics")["age"].alias("age"), F.col("demographics")["gender"].alias("gender"), F.try_element_at("smoking_history", F.lit("quit")).alias("quit"))
    out = _run(live.fold_profiles(_feed(spark, tmp_path, flat)), tmp_path, "update", "prof")
    last = out.groupBy("patient").agg(F.max_by(F.struct("age", "gender", "quit", "sessions"), "sessions").alias("p"))
    want = profiles.fold_scalars(u)
    assert {r.patient: tuple(r.p) for r in last.collect()} == {
        r.patient: (r.age, r.gender, (r.smoking_history or {}).get("quit"), r.sessions) for r in want.collect()
    }


def test_review_upsert_stream(spark, tmp_path):
    table, rejects = str(tmp_path / "cases"), str(tmp_path / "rejects")
    cases = spark.createDataFrame([(i, "pending", None, None) for i in range(5)], "case_id long, review_status string, doctor_diagnosis string, reviewed_at timestamp")
    upserts.create(cases, table, "case_id", buckets=3)
    schema = "reviewed_at timestamp, case_id long, doctor_decision string, doctor_diagnosis string"
    rows = [(_at(1), 0, "confirmed", ""), (_at(2), 1, "rejected", "flu"), (_at(3), 2, "rejected", " "), (_at(4), 0, "Rejected", "cold"), (_at(5), 3, "maybe", "")]
    feed = _feed(spark, tmp_path, spark.createDataFrame(rows, schema), files=2)
    q = feed.writeStream.foreachBatch(upserts.review_sink(table, rejects, 3)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    now = {r.case_id: (r.review_status, r.doctor_diagnosis) for r in upserts.read_current(spark, table).collect()}
    assert now == {0: ("rejected", "cold"), 1: ("rejected", "flu"), 2: ("pending", None), 3: ("pending", None), 4: ("pending", None)}
    assert spark.read.parquet(rejects).count() == 2
