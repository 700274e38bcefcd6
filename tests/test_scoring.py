import itertools
import random
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from pagewright.functions import responses as J
from pagewright.operators import scoring as S


def test_set_and_list_scores(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(S.set_f1(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
    rows = spark.createDataFrame(
        [("unordered_list", "a;b", "b; A"), ("ordered_list", "a;b;c", "a;c;b"), ("number", "25%", "0.25"), ("string", "「Ｘ」", "x"), ("unordered_list", "", ""), ("string", None, "y"), ("unordered_list", "1.0;2", "2;1")],
        "f string, r string, p string",
    )
    got = [r[0] for r in rows.select(S.answer_score(F.col("f"), F.col("r"), F.col("p"))).collect()]
    assert got == pytest.approx([1.0, 2 / 3, 1.0, 1.0, 1.0, 0.0, 1.0])


def test_matching_beats_greedy():
    assert S.maximum_matching([[True, True], [True, False]]) == 2
    with pytest.raises(ValueError):
        S.maximum_matching([[True], [True, False]])
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        e = [[rng.random() < 0.4 for _ in range(m)] for _ in range(n)]
        small, big = min(n, m), max(n, m)
        t = e if n <= m else [list(x) for x in zip(*e)]
        assert S.maximum_matching(e) == max(sum(t[i][p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))


def test_statistics_against_plain_code(spark):
    deltas = [0.2, -0.1, 0.05, 0.0]
    df = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(deltas)], "document string, delta double")
    row = S.delta_summary(df).first()
    assert (row["documents"], row["improved"], row["tied"], row["regressed"]) == (4, 2, 1, 1) and row["mean_delta"] == pytest.approx(0.0375)
    outcomes = [abs(fmean(s * d for s, d in zip(signs, deltas))) for signs in itertools.product((-1, 1), repeat=4)]
    assert S.sign_flip(df).first()["p_value"] == pytest.approx(sum(o >= abs(fmean(deltas)) - 1e-15 for o in outcomes) / 16)
    rng = random.Random(3)
    means = sorted(fmean(deltas[rng.randrange(4)] for _ in range(4)) for _ in range(400))
    got = S.bootstrap_interval(df, "document", 3, 400).first()
    assert (got["lower"], got["upper"]) == pytest.approx((means[int(0.025 * 400)], means[int(0.975 * 400)]))


def test_summary_keeps_null_slices_apart(spark):
    df = spark.createDataFrame([("a", "ja", 1.0), ("a", None, 0.0), (None, "ja", 0.5)], "document string, language string, v double")
    rows = {(r["dimension"], r["value"]): r for r in S.score_summary(df, ["v"], "document", ["language"]).collect()}
    assert rows["all", None]["questions"] == 3 and rows["language", None]["v"] == 0.0 and rows["document", None]["v"] == 0.5
    assert rows["document_macro", None]["v"] == 0.5


RESPONSES = [
    ('say {"answer":"a } brace","evidence_pages":[1,2,1],"confidence":0.5,"abstain":false} end', None),
    ('<think>{</think> {"answer":"x","evidence_pages":[],"confidence":1,"abstain":false}', None),
    ("I cannot answer", "missing_json_object"),
    ("<think> never ends {}", "missing_json_object"),
    (None, "missing_json_object"),
    ('{"answer":"guess","evidence_pages":[],"confidence":0.5,"abstain":true}', "schema_error:abstaining"),
    ('{"answer":"x","evidence_pages":[2.0],"confidence":0.5,"abstain":false}', "schema_error:evidence_pages must contain integers"),
    ('{"answer":"x","evidence_pages":[3],"confidence":0.5,"abstain":false}', "schema_error:evidence page 3"),
    ('{"answer":"x","evidence_pages":[true],"confidence":0.5,"abstain":false}', "schema_error"),
    ('{"answer":"x"}', "schema_error:response keys"),
    ("{bad}", "invalid_json"),
]


def test_responses_are_never_dropped(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESPONSES)], "i int, t string")
    rows = df.select("i", J.parse_response(F.col("t"), F.array(F.lit(1), F.lit(2))).alias("p")).orderBy("i").collect()
    assert len(rows) == len(RESPONSES)
    for r, (_, error) in zip(rows, RESPONSES):
        assert (r["p"]["error"] is None) == (error is None) and (error is None or r["p"]["error"].startswith(error))
    assert rows[0]["p"]["answer"] == "a } brace" and rows[0]["p"]["evidence_pages"] == [1, 2]


def test_coded_parser(spark):
    cases = [
        ('```json\n{"answer":[1," b "],"evidence_pages":[2,1],"confidence":0.5,"abstain":false}\n```', "ordered_list", None), ('{"answer":1', "number", "unterminated_json_object"),
        ('{"answer":[1],"evidence_pages":[1],"confidence":0.5,"abstain":false}', "string", "wrong_answer_type"), ('{"answer":"a","evidence_pages":[0],"confidence":0.5,"abstain":false}', "string", "invalid_pages"),
        ('{"answer":"a","evidence_pages":[7],"confidence":0.5,"abstain":false}', "string", "out_of_scope_page"), ('{"answer":"a","evidence_pages":[],"confidence":0.5,"abstain":true}', "string", "invalid_abstention"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, t string, f string")
    rows = df.select("i", J.parse_reader(F.col("t"), F.col("f"), F.array(F.lit(1), F.lit(2))).alias("p")).orderBy("i").collect()
    assert [r["p"]["error_code"] for r in rows] == [c[2] for c in cases]
    assert rows[0]["p"]["answer"] == '["1", "b"]' and rows[0]["p"]["evidence_pages"] == [1, 2]
