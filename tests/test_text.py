import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as X


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


def toks(spark, t, how="nfkc_casefold"):
    return one(spark, lambda c: X.tokens(X.folded(c, how)), t)


def test_tokens_fold_forms_that_are_the_same(spark):
    assert toks(spark, "ＡＢＣ") == toks(spark, "abc") == ["w:abc", "c2:ab", "c2:bc", "c3:abc"]
    assert toks(spark, "Hà Nội") == toks(spark, "Hà Nội")
    assert toks(spark, "ma") != toks(spark, "má")
    assert "c2:売上" in toks(spark, "年間売上高")
    assert toks(spark, " \n!? ") == [] and toks(spark, "") == []
    assert toks(spark, "ẞ x") == ["w:ss", "c2:ss", "w:x"]


@pytest.mark.parametrize("t", ["", "a", "ab cde", "売上高 12", None])
def test_token_count_is_the_number_of_tokens(spark, t):
    f = lambda c: F.struct(X.token_count(F.lower(c)).alias("n"), F.size(X.tokens(F.coalesce(F.lower(c), F.lit("")))).alias("m"))
    r = one(spark, f, t)
    assert r["n"] == r["m"]


def test_normalized_texts_and_numbers(spark):
    assert one(spark, X.normalize_text, " ＡＢＣ 日本語。") == "abc 日本語"
    assert one(spark, X.decimal_key, "1,000") == one(spark, X.decimal_key, "1e3") == "1E+3"
    assert one(spark, X.decimal_key, "25%") == "0.25" and one(spark, X.decimal_key, "(1)") is None
    assert one(spark, X.decimal_key, None) is None


def test_pages_and_lists(spark):
    assert one(spark, X.evidence_pages, "[3, 1, 3]") == [1, 3] and one(spark, X.evidence_pages, "[0]") is None
    assert one(spark, X.page_references, "[1, 3, 3]") == [1, 3] and one(spark, X.page_references, "pages 2 and 7") == [2, 7]
    assert one(spark, X.page_references, "N/A") == []
    for t in ('["a", "b"]', "a\nb", "a; b", "- a\n- b", "a | b"):
        assert one(spark, X.list_answer, t) == ["a", "b"], t
    assert one(spark, X.list_answer, "  ") == [] and one(spark, X.list_answer, "one") == ["one"]


def test_classes(spark):
    assert one(spark, X.classify_language, "売上") == "ja" and one(spark, X.classify_language, "độ ẩm") == "vi"
    assert one(spark, lambda c: X.classify_language(c, "vi"), "plain") == "vi"
    assert [one(spark, X.answer_type, t) for t in ("12.5", '["a", "b"]', "alpha; beta", "", "word", "w " * 13)] == ["number", "list", "list_like", "missing", "short_text", "long_text"]
    assert [one(spark, X.value_kind, t) for t in ("1", "[1]", '{"a":1}', "{x", "None")] == ["numeric", "list", "dict", "string", "missing"]
    assert one(spark, X.answer_format, " Short-Text ") == "string" and one(spark, X.answer_format, "poem") is None
    assert one(spark, X.split_of_key, "raw/train_pdfs/a.pdf") == "train" and one(spark, X.language_of_key, "x/J_1.pdf") == "ja"


def test_small_functions(spark):
    import hashlib

    assert one(spark, X.unspaced_japanese, "配水 管 a b") == "配水管 a b"
    want = int.from_bytes(hashlib.sha256(b"7:q1").digest()[:8], "big") % (2**31 - 1)
    assert one(spark, lambda c: X.stable_seed(7, c), "q1") == want
    assert one(spark, X.redact, "id 123456789012 s3://my-bucket/k " + "a" * 40) == "id <redacted-account> s3://<redacted-bucket>/k " + "a" * 40
    assert one(spark, X.s3_parts, "s3://b/k/x") == ("b", "k/x") and one(spark, X.s3_parts, "b/k") == (None, None)
    assert one(spark, X.safe_identifier, "a b/c").startswith("a-b-c-")
