"""Sources and sinks on small files."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import stages as C
from pagewright.operators import tables as T
from pagewright.sinks import submission as K
from pagewright.sources import files as S
from pagewright.streaming import events as E


def test_labels_are_typed_and_wrong_rows_are_named(spark, tmp_path):
    head = ",".join([*S.LABELS, "extra"])
    (tmp_path / "ok.csv").write_bytes(("﻿" + head + '\na,d,"q\nwith line",Ordered-List,"x","[2, 1]",ja,\nb,d,q,text,x,3,vi,z\n').encode())
    rows = S.require_valid(S.typed_labels(S.read_rows(spark, str(tmp_path / "ok.csv"), S.LABELS))).orderBy("question_id").collect()
    assert [(r["question_id"], r["answer_format"], list(r["evidence_pages"]), r["row"]) for r in rows] == [("a", "ordered_list", [1, 2], 2), ("b", "string", [3], 3)]
    (tmp_path / "bad.csv").write_text(f"{head}\na,d,q,other,x,1,ja,\nb,d,q,text,x,0,ja,\nb,d,q,text,x,1,ja,\nc,d\n ,d,q,text,x,1,ja,\nd,d,q,text,x,,ja,\n")
    bad = S.typed_labels(S.read_rows(spark, str(tmp_path / "bad.csv"), S.LABELS))
    assert {r["row"]: r["error"] for r in bad.collect()} == {2: "unknown_format", 3: "repeated_id", 4: "repeated_id", 5: "short_row", 6: "blank_id", 7: "no_pages"}
    with pytest.raises(ValueError, match="2: unknown_format"):
        S.require_valid(bad)
    assert S.read_rows(spark, str(tmp_path / "ok.csv"), S.QUESTIONS, exact=True).collect()[0]["row_error"] == "wrong_header"


def test_a_submission_goes_round(spark, tmp_path):
    template = spark.createDataFrame([(0, "b", "d", "unordered_list"), (1, "a", "d", "string")], "ordinal int, id string, document_id string, answer_format string")
    predictions = spark.createDataFrame([("a", 'say "x"\n, y', [2, 1]), ("b", "('x', )", [1])], "id string, answer string, evidence_pages array<int>")
    counts = spark.createDataFrame([("d", 2)], "document_id string, page_count int")
    assert {r["id"]: r["error"] for r in K.submission_rows(template, predictions, counts).collect()} == {"a": None, "b": "bad_list"}
    predictions = predictions.withColumn("answer", F.when(F.col("id") == "b", "['x', 1]").otherwise(F.col("answer")))
    data = K.build_submission(template, predictions, counts)
    assert data == 'id,answer,evidence_page_number\nb,"[""x"",1]",[1]\na,"say ""x""\n, y","[1,2]"\n'.encode()
    assert K.check_submission(data, ["b", "a"], {"a": 2, "b": 2}, {"a": "string", "b": "unordered_list"}) == {"rows": 2}
    for wrong in (lambda: K.check_submission(data, ["a", "b"]), lambda: K.check_submission(data, ["b", "a"], {"a": 1, "b": 1})):
        with pytest.raises(ValueError):
            wrong()
    more = predictions.unionByName(spark.createDataFrame([("z", "x", [1])], predictions.schema))
    with pytest.raises(ValueError, match="unknown_id=1"):
        K.build_submission(template, more, counts)
    assert K.provenance_violations({"split": "test", "model_id": " ", "model_revision": "a" * 40}, {"split": "test", "n": 1}) == ["n", "model_id", "code_commit"]
    q = spark.createDataFrame([("a", "d", "q", "string", "ja"), ("b", "d", "q", "list", "vi")], "id string, file_id string, question string, answer_format string, language string")
    assert S.input_violations(q, template, {"questions": 2, "documents": 1, "language": {"ja": 1, "vi": 1}}).count() == 0
    assert {r[0] for r in S.input_violations(q.limit(1), template, {"questions": 2, "language": {"xx": 1}}).collect()} == {"id_not_in_questions", "questions_count", "language_counts"}


def test_archives_are_read_only_where_they_are_safe(spark):
    def tar(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members:
                m = tarfile.TarInfo(name)
                if data is None:
                    m.type, m.linkname = tarfile.SYMTYPE, "x"
                    t.addfile(m)
                else:
                    m.size = len(data)
                    t.addfile(m, io.BytesIO(data))
        return bytearray(out.getvalue())

    files = spark.createDataFrame([("a", tar(("r/1.txt", b"one"), ("r/2.txt", b""))), ("b", tar(("../x", b"1"))), ("c", tar(("ok", b"1"), ("l", None))), ("d", bytearray(b"no")), ("e", None)], "path string, content binary")
    got = sorted((r["file"], r["name"], r["error"]) for r in S.tar_members(files).collect() if r["file"] != "d")
    assert got == [("a", "r/1.txt", None), ("a", "r/2.txt", None), ("b", "../x", "unsafe_name"), ("c", "l", "link")]
    assert S.tar_members(files).filter("error = 'not_a_tar'").count() == 1


def test_listings_are_whole(spark):
    pages = {None: "Next Page Token = t1\nname,size,creationDate\nb.pdf,2,x\n", "t1": "name,size,creationDate\na.pdf,1,x\nb.pdf,2,x\n"}
    listed = S.list_pages(spark, pages.get)
    assert [(r["name"], r["size"]) for r in listed.collect()] == [("a.pdf", 1), ("b.pdf", 2)]
    with pytest.raises(ValueError, match="again"):
        S.list_pages(spark, lambda t: pages[None])
    assert sorted(r["stem"] for r in S.inventory(listed, F.col("name").endswith(".pdf")).collect()) == ["a", "b"]


def test_stored_tables_and_reports_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    out, there = C.stage(spark, str(tmp_path), {"q": 1}, lambda: df)
    assert not there and C.content_hash(out) == C.content_hash(df.orderBy("v")) != C.content_hash(df.limit(1))
    assert C.stage(spark, str(tmp_path), {"q": 1}, lambda: 1 / 0)[1]
    folder = next(p for p in tmp_path.iterdir() if p.is_dir()) / "data"
    df.limit(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(ValueError, match="rows"):
        C.stage(spark, str(tmp_path), {"q": 1}, lambda: df)
    sha = K.write_report(spark, f"{tmp_path}/report.json", {"b": 1})
    assert K.write_report(spark, f"{tmp_path}/report.json", {"b": 1}) == sha and S.read_report(spark, f"{tmp_path}/report.json") == '{"b":1}\n'
    with pytest.raises(ValueError):
        K.write_report(spark, f"{tmp_path}/report.json", {"b": 2})
    K.write_json_lines(df, f"{tmp_path}/lines", "k")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()) == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    K.write_rows([df, df.select(F.lit(3).alias("k"), F.lit("x").alias("w"))], f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/csv", header=True).fillna("").collect())) == [("1", "a", ""), ("2", "", ""), ("3", "", "x"), ("3", "", "x")]


def test_catalogs_costs_and_jobs(spark):
    needs = spark.createDataFrame([("a", 10, 1), ("b", 99, 1)], "m string, gib int, gpus int")
    catalog = spark.createDataFrame([("s", 8, 1), ("l", 16, 2)], "kind string, gib int, gpus int")
    assert [(r["m"], r["kind"]) for r in T.fitting(needs, catalog, ["gib", "gpus"]).collect()] == [("a", "l")]
    jobs = spark.createDataFrame([(1.0, 3600, 1), (float("inf"), 1, 1), (2.0, 0, 1), (50.0, 7200, 2), (None, 1, 1)], "r double, s int, n int")
    assert [(r["maximum_cost"], r["cost_error"]) for r in T.cost_estimates(jobs, "r", "s", "n", cap=10.0).collect()] == [(1.25, None), (None, "bad_rate"), (None, "bad_seconds"), (250.0, "over_cap"), (None, "bad_rate")]
    wanted = spark.createDataFrame([(1, "ml.g5 xlarge"), (2, "none")], "k int, name string")
    offers = spark.createDataFrame([("ML-G5.xlarge", 3), ("other", 1)], "name string, quota int")
    assert {r["k"]: (r["matches"], r["offer"] and r["offer"]["quota"]) for r in T.single_match(wanted, offers, "k", "name").collect()} == {1: (1, 3), 2: (0, None)}
    j = spark.createDataFrame([("x-Oracle-1", 1, "InProgress"), ("oracle-2", 2, "Failed"), ("new", 3, "Stopping"), (None, 4, "InProgress")], "name string, at int, status string")
    assert E.new_job(j, j.filter("at = 2"), "name", "at", F.lit(0), "oracle").first()["name"] == "x-Oracle-1"
    assert sorted(r[0] for r in E.active_jobs(j, "name", "status").collect()) == ["new", "x-Oracle-1"]
    line = E.as_events(j.withColumn("ts", F.timestamp_seconds("at")).withColumn("token", F.lit("t")).limit(1), "c", F.lit("e"), "ts", ["token"]).first()[0]
    assert '"token":"<redacted>"' in line and '"timestamp_utc":"1970-01-01T00:00:01.000Z"' in line
