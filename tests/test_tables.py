import pytest
from pyspark.sql import functions as F

from pagewright.operators import stages as C
from pagewright.operators import tables as T
from pagewright.sinks import submission as K
from pagewright.sources import files as R
from pagewright.streaming import events as E


def test_folds_don_t_leak(spark):
    q = spark.createDataFrame([(f"d{i}", f"q{i}") for i in range(5)], "d string, q string")
    folds = T.leave_one_out(q, "d", "q")
    assert folds.count() == 5 and {(r["validation"], r["training"]) for r in folds.collect()} == {(1, 4)}
    roles = T.fold_roles(q, "d", "q", folds.limit(2)).groupBy("fold", "role").count().collect()
    assert sorted(r["count"] for r in roles) == [1, 1, 4, 4]
    nested = T.nested_folds(q, "d", "q")
    assert {(r["inner_folds"], r["validated"], r["least_training"], r["most_training"]) for r in nested.collect()} == {(4, 4, 3, 3)} and nested.count() == 5
    assert sorted(r["alias"] for r in T.aliases(q, "d", "doc-").collect()) == [f"doc-0{i}" for i in range(1, 6)]


def test_profiles_and_checks(spark):
    df = spark.createDataFrame([("a", 1), (" N/A ", 2), (None, 3), ("a", 4)], "v string, n int")
    r = T.column_profile(df, ["v"]).first()
    assert (r["rows"], r["missing"], r["nonmissing"], r["distinct_values"], r["max_length"]) == (4, 2, 2, 1, 1)
    assert T.numeric_summary(df.filter("n > 9"), "n").first()["n"] == 0
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 1)], "d string, n int")
    assert sorted(r["d"] for r in T.page_sequence_violations(pages, "d", "n").collect()) == ["b", "c"]
    bad = T.violations(df, "n", {"small": F.col("n") < 3, "named": F.col("v").isNotNull()}).collect()
    assert sorted((r["n"], r["violation"]) for r in bad) == [(3, "named"), (3, "small"), (4, "small")]
    a = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5 + 1e-13), (2, 1e-13), (4, 1.0)], "k int, v double")
    assert sorted(r["k"] for r in T.unequal(a, b, "k", "v").collect()) == [2, 3, 4]


def test_submission_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(0, "q2", "d"), (1, "q1", "d")], "ordinal int, id string, document_id string")
    p = spark.createDataFrame([("q1", 'a, "b"', [2, 1]), ("q2", "none", [1])], "id string, answer string, evidence_pages array<int>")
    n = spark.createDataFrame([("d", 2)], "document_id string, page_count int")
    data = K.build_submission(t, p, n)
    assert data == b'id,answer,evidence_page_number\nq2,none,[1]\nq1,"a, ""b""","[1,2]"\n'
    assert K.check_submission(data, ["q2", "q1"]) == {"rows": 2}
    for q in (p.filter("id = 'q1'"), p.withColumn("evidence_pages", F.array(F.lit(3))), p.withColumn("evidence_pages", F.array(F.lit(1), F.lit(1)))):
        with pytest.raises(ValueError):
            K.build_submission(t, q, n)
    with pytest.raises(ValueError):
        K.check_submission(data, ["q1", "q2"])
    folder = K.store_bundle(str(tmp_path), data, {"split": "test"})
    assert K.store_bundle(str(tmp_path), data, {"split": "test"}) == folder
    with pytest.raises(ValueError):
        K.store_bundle(str(tmp_path), data, {"split": "other"})


def test_stages_are_reused(spark, tmp_path):
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    assert C.stage(spark, str(tmp_path), {"a": 1}, compute)[1] is False
    df, reused = C.stage(spark, str(tmp_path), {"a": 1}, compute)
    assert reused and df.count() == 3 and made == [1]
    done = spark.createDataFrame([(1, "x")], "id bigint, v string")
    out = C.resume(spark.range(3), done, "id", lambda t: t.withColumn("v", F.lit("new")))
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(0, "new"), (1, "x"), (2, "new")]
    with pytest.raises(ValueError):
        C.merge_ancestry(lambda n: (done, n), "a", "id")
    two = {"a": (done, "b"), "b": (done, None)}
    assert C.merge_ancestry(two.__getitem__, "a", "id").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,answer\n1,"x\ny"\n2,z\n'.encode())
    df = R.read_labels(spark, str(tmp_path / "a.csv"), ("id", "answer"), exact=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x\ny"), ("2", "z")]
    with pytest.raises(ValueError):
        R.read_labels(spark, str(tmp_path / "a.csv"), ("id", "other"))
    with pytest.raises(ValueError):
        R.require_unique(df.unionAll(df), "id")
    b = spark.createDataFrame([(b"caf\xe9",), ("é".encode(),)], "b binary")
    assert [r[0] for r in b.select(R.decoded(F.col("b"))).collect()] == ["café", "é"]
    pages = R.pages_of_text(spark.createDataFrame([("d", "one\f \fthree"), ("e", None)], "d string, t string"), "d", "t")
    assert sorted((r["document_id"], r["page_number"], r["status"]) for r in pages.collect()) == [("d", 1, "ok"), ("d", 2, "textless"), ("d", 3, "ok"), ("e", 1, "textless")]


def test_events_and_stream(spark, tmp_path):
    rows = [(1, "j", 0, "Pending"), (2, "j", 40, "Pending"), (3, "j", 50, "Running"), (4, "j", 60, "Running"), (5, "k", 0, None), (6, "k", 5, None)]
    log = spark.createDataFrame(rows, "id int, job string, s int, status string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["id"] for r in E.status_changes(log, "job", "ts", "id", "status").collect()) == [1, 3, 5]
    late = E.pending_timeouts(log, "job", "ts", "id", F.coalesce(F.col("status"), F.lit("")) == "Pending", 30).collect()
    assert [r["job"] for r in late] == ["j"]
    assert sorted(r["id"] for r in E.heartbeats(log, "job", "ts", "id").collect()) == [1, 2, 4, 5]
    assert E.deduplicated(log.unionAll(log), "id", "ts").count() == 6
    log.select("id", "job", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")).coalesce(1).write.json(str(tmp_path / "in"))
    stream = E.read_event_stream(spark, str(tmp_path / "in"), "id int, job string, ts timestamp")
    q = E.windowed_counts(E.deduplicated(stream, "id", "ts"), "ts", "job", "30 seconds").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
