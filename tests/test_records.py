"""Record scoring, judges, rounds of a search, run comparison and folds on small cases."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import responses as J
from pagewright.functions import text as X
from pagewright.operators import records as R
from pagewright.operators import tables as T


def test_records_score_whatever_is_missing(spark):
    refs = spark.createDataFrame([("a", "d", "vi", "string", "Mười", [1, 2], [1]), ("b", "d", "ja", "unordered_list", "x; y", [3], [3, 4]), ("c", "e", None, "number", None, None, None)], "question_id string, document_id string, language string, answer_format string, answer string, evidence_pages array<int>, available_pages array<int>")
    preds = spark.createDataFrame([("a", "MƯỜI.", [2, 9], True, False, None), ("b", "y", [3], True, False, None)], "question_id string, answer string, evidence_pages array<int>, schema_valid boolean, abstain boolean, parser_error string")
    got = {r["question_id"]: r for r in R.score_records(refs, preds).collect()}
    assert (got["a"]["answer_score"], got["a"]["evidence_f1"], got["a"]["retrieval_recall"], got["a"]["failure_category"]) == (1.0, 0.5, 0.5, "missing_evidence")
    assert got["b"]["answer_score"] == pytest.approx(2 / 3) and got["b"]["failure_category"] == "answer_incomplete_or_incorrect"
    assert got["c"]["failure_category"] == "invalid_response" and got["c"]["evidence_precision"] == 0
    assert [(r["question_id"], r["error"]) for r in R.coverage_errors(refs, preds).collect()] == [("c", "missing_prediction")]
    with pytest.raises(ValueError, match="missing_prediction=1"):
        R.require_coverage(refs, preds)
    assert R.diagnostics(R.score_records(refs.filter("1=0"), preds)).first()["answer_score"] == 0
    judged = spark.createDataFrame([("a", False)], "question_id string, equivalent boolean")
    assert R.score_records(refs, preds, judged).filter("question_id = 'a'").first()["answer_score"] == 0


def test_each_pair_is_judged_once_and_malformed_decisions_are_not_kept(spark):
    pairs = spark.createDataFrame([(1, "ja", "a", "a"), (2, "ja", "a", "a"), (3, "vi", "b", "c"), (4, "vi", "z", None), (5, "en", "p", "q")], "key int, language string, reference string, prediction string")
    known = spark.createDataFrame([("j1", "en", "p", "q", True), ("other", "vi", "b", "c", True)], "identity string, language string, reference string, prediction string, equivalent boolean")
    judge = lambda lang, a, b: a == b
    out, new = R.decide(pairs, known, judge, "j1")
    assert {r["key"]: r["equivalent"] for r in out.collect()} == {1: True, 2: True, 3: False, 4: None, 5: True}
    assert sorted((r["reference"], r["equivalent"]) for r in new.collect()) == [("a", True), ("b", False)]
    probes = pairs.filter("key in (1, 3)").withColumn("expected", F.col("key") == 1)
    assert R.require_probes(probes, judge) == 2
    with pytest.raises(ValueError):
        R.require_probes(probes.withColumn("expected", F.lit(True)), judge)


def test_a_search_reads_only_what_is_unresolved(spark):
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    candidates = spark.createDataFrame([(q, n, [n]) for q in "abc" for n in (1, 2, 3)], "question_id string, attempt int, pages array<int>")
    good = spark.createDataFrame([("a", 1), ("b", 2)], "question_id string, good int")
    answer = lambda rows: rows.join(good, "question_id", "left").withColumn("ok", F.col("attempt") == F.col("good"))
    got = {r["question_id"]: (r["resolved"], r["attempts"], r["attempt"]) for r in R.search_rounds(questions, candidates, answer, F.col("ok"), 3).collect()}
    assert got == {"a": (True, 1, 1), "b": (True, 2, 2), "c": (False, 3, 3)}


def test_runs_are_compared_where_they_are_compatible(spark):
    rows = [("r1", "k", "d1", 0.5), ("r1", "k", "d2", 0.5), ("r2", "k", "d1", 1.0), ("r2", "k", "d3", 0.5), ("r3", "other", "d1", 1.0)]
    got = R.compare_runs(spark.createDataFrame(rows, "run string, same string, d string, v double"), "run", "d", "d", "v", ["same"]).collect()
    assert [(r["left_run"], r["right_run"], r["documents"], r["missing"], r["improved"]) for r in got] == [("r1", "r2", 3, 2, 1)]
    bad = spark.createDataFrame([("d", 0.5, 0.5, 0.6), ("d", 2.0, 0.0, 1.0)], "d string, a double, e double, o double")
    assert {r["identity"]: r["violations"] for r in R.metric_identities(bad, "a", "e", "o", "d").collect()} == {"range": 1, "formula": 1, "weights": 0}


def test_folds_of_all_documents_break_no_rule(spark):
    q = spark.createDataFrame([(d, f"{d}{i}") for d in "abc" for i in range(3)], "d string, q string")
    folds = q.select("d").distinct().withColumn("fold", F.concat(F.lit("f-"), "d"))
    roles = T.fold_roles(q, "d", "q", folds)
    assert roles.count() == 27 and T.fold_violations(roles, q, "d", "q").count() == 0
    leak = roles.withColumn("role", F.when((F.col("fold") == "f-a") & (F.col("q") == "b1"), "validation").otherwise(F.col("role")))
    assert {r["violation"] for r in T.fold_violations(leak, q, "d", "q").collect()} == {"shared_document", "not_held_out_once"}
    assert T.fold_violations(roles.filter("1=0"), q, "d", "q").collect()[0]["rows"] == 9
    assert T.nested_pairs(q, "d", "q", ["a"]).count() == 2


def test_responses_never_kill_a_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    odd = [None, "", "{", "}{", '{"a": "\\', '{"answer": "x", "evidence_pages": [99999999999], "confidence": 1, "abstain": false}', '{"answer": ' + deep + "}", '{"answer": "x", "evidence_pages": [], "confidence": 1' + "0" * 400 + ', "abstain": false}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "k int, t string")
    got = [r["p"]["error"] for r in df.select("k", J.parse_response(F.col("t")).alias("p")).orderBy("k").collect()]
    assert got[:5] == ["missing_json_object"] * 5 and "99999999999" in got[5] and got[6].startswith("invalid_json") and "between" in got[7]
    strict = df.select(J.validate_text(F.col("t"), F.array(F.lit(1)), F.lit(None).cast("array<struct<page:int,text:string>>")).alias("p")).collect()
    assert not any(r["p"]["schema_valid"] for r in strict)
    reader = df.select(J.parse_reader(F.col("t"), F.lit("string"), F.array(F.lit(1))).alias("p")).collect()
    assert all(r["p"]["error_code"] for r in reader)
    r = df.select(J.decision(F.lit(" YES ")).alias("y"), J.decision(F.lit("yes")).alias("n"), J.complete(F.lit(True), F.lit(False), F.lit(" [] "), F.array(F.lit(1))).alias("c"), J.json_candidate(F.lit("<think>x</think> plain")).alias("j")).first()
    assert (r["y"], r["n"], r["c"], r["j"]) == (True, None, False, "plain")


def test_text_functions_take_anything(spark):
    odd = [None, "", " ", "[", "(1", "1" * 6000, "[" * 200, "{1, 2}", "'3'", "b'x'", "nan", "[1e400, 2]", "1_000", "'" * 99]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for f in (X.evidence_pages, X.page_references, X.list_answer, X.answer_type, X.value_kind, X.decimal_key, X.redact, X.sanitize_json, X.stable_hash, X.public_metadata, X.event_line, X.safe_identifier):
        assert df.select(f(F.col("t")).alias("x")).count() == len(odd) and len(df.select(f(F.col("t")).alias("x")).collect()) == len(odd)
    assert df.filter("t = '{1, 2}'").select(X.page_references(F.col("t"))).count() == 1
