from math import log

import pytest
from pyspark.sql import functions as F

from pagewright.operators import ranking_metrics as M
from pagewright.operators import retrieval as R


def frames(spark, pages, queries):
    p = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(pages)], "document_id string, page_number int, text string")
    q = spark.createDataFrame([(i, "d", t) for i, t in enumerate(queries)], "query_id int, document_id string, question string")
    return p, q


def test_hand_calculated_score(spark):
    rows = R.rank(*frames(spark, ["x x", "y"], ["x"])).orderBy("rank").collect()
    assert rows[0]["score"] == pytest.approx(log(2) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / 1.5)), abs=1e-9)
    assert (rows[1]["page_number"], rows[1]["score"]) == (2, 0.0)


def test_ties_go_by_page_and_repeated_terms_count_once(spark):
    p, q = frames(spark, ["same", "same", "", None], ["same same", "same", "", None])
    rows = R.rank(p, q).orderBy("query_id", "rank").collect()
    by = {k: [r["page_number"] for r in rows if r["query_id"] == k] for k in range(4)}
    assert by[0] == by[1] == by[2] == by[3] == [1, 2, 3, 4]
    assert [r["score"] for r in rows if r["query_id"] == 0] == [r["score"] for r in rows if r["query_id"] == 1]
    assert {r["query_id"]: r["zero_signal"] for r in R.nested(R.rank(p, q)).collect()} == {0: False, 1: False, 2: True, 3: True}


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_top_k_is_the_head_of_rank(spark, k):
    p, q = frames(spark, ["a b", "", "b c", "zz", "a a c", "q"], ["a", "c b", "none here zz", ""])
    want = R.rank(p, q).filter(F.col("rank") <= k).orderBy("query_id", "rank").collect()
    assert R.top_k(p, q, k).select("query_id", "document_id", "page_number", "score", "rank").orderBy("query_id", "rank").collect() == want


@pytest.mark.parametrize("k1,b", [(0, 0.5), (1.2, -0.1), (float("nan"), 0.5), (1.2, float("inf"))])
def test_parameters_are_checked(spark, k1, b):
    with pytest.raises(ValueError):
        R.scores(*frames(spark, ["x"], ["x"]), k1=k1, b=b)


def test_brute_force(spark):
    """Whole scores against a plain computation with dictionaries."""
    from collections import Counter
    from math import log1p
    from unicodedata import normalize

    import regex

    texts = ["Độ ẩm kho lạnh", "Kho lạnh 12", "倉庫の温度", "倉庫ＡＢ kho", ""]
    asks = ["kho lạnh", "倉庫 AB", "x"]

    def tokens(t):
        out = []
        for s in regex.findall(r"[\p{L}\p{N}]+", normalize("NFKC", t).casefold()):
            out += ["w:" + s, *(s[i : i + 2] for i in range(len(s) - 1)), *(s[i : i + 3] for i in range(len(s) - 2))]
        return out

    bags = [Counter(tokens(t)) for t in texts]
    avg = sum(sum(b.values()) for b in bags) / len(bags)
    want = {}
    for q, a in enumerate(asks):
        for i, b in enumerate(bags):
            s = 0.0
            for t in set(tokens(a)):
                df = sum(t in x for x in bags)
                if b[t]:
                    s += log1p((len(bags) - df + 0.5) / (df + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg))
            want[q, i + 1] = s
    got = {(r["query_id"], r["page_number"]): r["score"] for r in R.rank(*frames(spark, texts, asks)).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, p, i + 1) for i, p in enumerate([3, 1, 2, 4])], "query_id int, page_number int, rank int")
    relevant = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id int, page_number int")
    rows = {(r["query_id"], r["k"]): r for r in M.at_budgets(ranked, relevant, (1, 2, 3, 10)).collect()}
    assert (rows[1, 2]["recall"], rows[1, 2]["all_evidence"], rows[1, 2]["reciprocal_rank"]) == (0.5, 0.0, 0.5)
    assert rows[1, 3]["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert rows[2, 10]["ndcg"] == 0.0
    for k, n in ((1, 2), (2, 3), (3, 10)):
        assert rows[1, k]["recall"] <= rows[1, n]["recall"] and rows[1, k]["all_evidence"] <= rows[1, k]["recall"]


def test_extractive_answers_and_abstentions(spark):
    p, q = frames(spark, ["The gate closes at nine.\nThe hall opens at six.", "Nothing here", ""], ["When does the gate close?", "", "?!", "zzqx"])
    rows = {r["query_id"]: r for r in R.extractive_answers(p, q).collect()}
    assert rows[0]["answer"] == "The gate closes at nine." and rows[0]["evidence_pages"] == [1] and not rows[0]["abstain"]
    assert [rows[i]["reason"] for i in (1, 2, 3)] == ["EMPTY_QUERY", "NO_SEARCHABLE_TERMS", "NO_MATCHING_EVIDENCE"]
    assert all(rows[i]["answer"] == "" and rows[i]["evidence_pages"] == [] for i in (1, 2, 3))


def test_page_windows(spark):
    df = spark.createDataFrame([([3, 1, 2, 6, 5, 4],)], "r array<int>")
    got = df.select(R.page_search_order(F.col("r"), F.size("r")).alias("x")).first()["x"]
    assert got == [[1, 2, 3, 6], [2, 3, 4], [1, 2], [3], [1], [2], [6], [4, 5]]
    f = spark.createDataFrame([([2, 9], True, [1, 2, 3]), ([], True, [1, 2]), ([1], False, [1, 2])], "c array<int>, v boolean, p array<int>")
    assert [r[0] for r in f.select(R.focus_pages(F.col("c"), F.col("v"), F.col("p"))).collect()] == [[2], [1, 2], [1, 2]]


def test_empty_and_null_inputs_have_results(spark):
    from pagewright.operators import retrieval as R

    pages = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, None), (None, 1, "x")], "document_id string, page_number int, text string")
    queries = spark.createDataFrame([(1, "d", "alpha"), (2, "d", None), (3, None, "x"), (4, "zz", "alpha"), (5, "d", ""), (6, "d", "alpha " * 100)], "query_id bigint, document_id string, question string")
    got = sorted((r["query_id"], r["page_number"], r["rank"]) for r in R.top_k(pages, queries, 2).collect())
    assert got == [(q, p, p) for q in (1, 2, 5, 6) for p in (1, 2)]
    assert R.top_k(pages.filter("1=0"), queries, 2).count() == 0 and R.top_k(pages, queries.filter("1=0"), 2).count() == 0
    answers = {r["query_id"]: (r["answer"], r["reason"]) for r in R.extractive_answers(pages, queries).collect()}
    assert answers == {1: ("alpha beta", None), 2: ("", "EMPTY_QUERY"), 3: ("", "NO_MATCHING_EVIDENCE"), 4: ("", "NO_MATCHING_EVIDENCE"), 5: ("", "EMPTY_QUERY"), 6: ("", "QUESTION_TOO_LONG")}


def test_documents_of_several_blocks_are_ranked_as_whole_ones(spark, monkeypatch):
    words = ["gate", "hall", "倉庫", "kho lạnh", "meter", "ab", "a"]
    p = [(d, i + 1, f"{words[i % 7]} {words[i * i % 5]}\n{words[i % 3]}" if i % 6 else None, 100 * n + i) for n, d in enumerate("de") for i in range(40)]
    pages = spark.createDataFrame(p + p[::3], "document_id string, page_number int, text string, page_id int")
    queries = spark.createDataFrame([(100 * n + i, d, w) for n, d in enumerate("de") for i, w in enumerate([*words, "gate meter", "", None])], "query_id int, document_id string, question string")
    results = (
        lambda: R.top_k(pages, queries, 5, page_key="page_id"), lambda: R.rank(pages, queries, page_key="page_id"), lambda: R.rankings(pages, queries, page_key="page_id"),
        lambda: R.zero_signals(pages, queries, page_key="page_id"), lambda: R.extractive_answers(pages, queries, page_key="page_id"),
    )
    got = lambda f: sorted(map(repr, f().select(*sorted(f().columns)).collect()))
    want = [got(f) for f in results]
    monkeypatch.setattr(R, "BLOCK_PAGES", 15)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(R, "BLOCK_CHARS", 10_000)
    monkeypatch.setattr(R, "PAIRS", 50)
    assert [got(f) for f in results] == want
    assert len(want[1]) == 2 * 40 * 10


@pytest.mark.parametrize("name,least", [("bm25_topk", 5), ("bm25_topk_lower", 5), ("extractive_answers", 1), ("extractive_answers_lower", 1)])
def test_no_token_of_a_page_is_stored(spark, monkeypatch, name, least):
    from pagewright.plans import retrieval as P

    stored = []
    monkeypatch.setattr(R, "materialize", lambda df, name="t": stored.append(df.count()) or df)
    pages = spark.createDataFrame([("d", i, f"gate {i} hall {i} meter") for i in range(50)], "document_id string, page_number int, text string").withColumn("page_id", F.col("page_number")).withColumn("status", F.lit("ok"))
    monkeypatch.setattr(P, "_delivered", lambda *_: pages, raising=False)
    monkeypatch.setattr(P, "pages", lambda *_: pages.drop("page_id"))
    monkeypatch.setattr(P, "questions", lambda *_: spark.createDataFrame([(1, "d", "gate hall meter")], "query_id bigint, document_id string, question string"))
    assert P.QUERIES[name](spark, "").count() == least
    assert max(stored) <= 5


@pytest.mark.parametrize("name", ["select_pages", "ranking_metrics", "retrieval_by_slice", "page_search_order"])
def test_pages_that_a_result_does_not_hold_are_no_rows(spark, monkeypatch, name):
    from pagewright.plans import retrieval as P

    monkeypatch.setattr(R, "rank", lambda *a, **k: pytest.fail("every page of every query would be a row"))
    assert P.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_page_sets_of_a_long_document(spark):
    df = spark.range(1).select(F.sequence(F.lit(8000), F.lit(1), F.lit(-1)).cast("array<int>").alias("r"))
    one = df.select(F.size(R.page_search_order(F.col("r"), F.size("r"))).alias("n")).first()["n"]
    assert one == 1 + 2 + 4 + 1999


def test_metrics_of_hits_are_those_of_all_relevant_pages(spark, monkeypatch):
    from pagewright.plans import retrieval as P

    monkeypatch.setattr(M, "at_budgets", lambda *a, **k: pytest.fail("every relevant page of every query would be a row"))
    assert P.page_relevance_metrics(spark, "/root/testdata/sf0.001").count() == 375
