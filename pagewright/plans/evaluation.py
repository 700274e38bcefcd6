"""Queries on scores, statistics, responses and folds, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as J
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import tables as T
from ..sources.tables import table

VALUES = ("answer_score", "evidence_f1", "local_lava")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """refinement, a re-delivered record once, documents under one spelling where it is plain ASCII."""
    r = T.once(table(spark, sf, "refinement").drop("loaded_at"), "record_id")
    return r.withColumn("document", F.when(~X.is_nullish(F.col("document")), F.lower(X.strip(F.col("document")))))


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_summary(results(spark, sf), VALUES, "document", ["language", "answer_format"])


def slice_scores(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("language", "answer_format").agg(F.count("*").alias("questions"), F.countDistinct("document").alias("documents"), *[F.round(F.avg(v), 9).alias(v) for v in VALUES])


def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    c = S.failure_category(F.coalesce("schema_valid", F.lit(False)), F.coalesce("retrieval_recall", F.lit(0.0)), F.coalesce("answer_score", F.lit(0.0)), F.coalesce("evidence_f1", F.lit(0.0)))
    return results(spark, sf).groupBy(c.alias("category")).agg(F.count("*").alias("questions"))


def gap_profile(spark: SparkSession, sf: str) -> DataFrame:
    return S.gap_profile(results(spark, sf), "answer_format", "answer_score", "evidence_f1")


def supporting_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return results(spark, sf).agg(
        F.round(F.avg("evidence_precision"), 9).alias("evidence_precision"), F.round(F.avg("evidence_recall"), 9).alias("evidence_recall"), rate(F.col("evidence_f1") == 1).alias("exact_sets"), rate(F.col("abstain")).alias("abstentions"),
        rate(F.col("answer_score") > 0).alias("credited"), F.round(F.percentile("input_pages", F.lit(0.5)), 9).alias("pages_p50"), F.round(F.percentile("input_pages", F.lit(0.95)), 9).alias("pages_p95"),
        F.round(F.sum("input_pages") / F.nullif(F.sum(F.col("answer_score") + 1), F.lit(0.0)), 6).alias("pages_by_score"),
    )


def parser_errors(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy(F.coalesce("parser_error", F.lit("none")).alias("parser_error")).agg(F.count("*").alias("records"), F.max("input_pages").alias("most_pages"))


def _deltas(spark: SparkSession, sf: str, by: str) -> DataFrame:
    r = results(spark, sf).filter(F.col(by).isNotNull())
    means = r.groupBy(by).agg(F.avg("evidence_f1").alias("a"), F.avg("answer_score").alias("b"))
    return S.paired(means.select(by, F.col("a").alias("v")), means.select(by, F.col("b").alias("v")), by, "v").withColumn("delta", F.round("delta", 9))


def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return S.delta_summary(_deltas(spark, sf, "document"))


def sign_flip_p(spark: SparkSession, sf: str) -> DataFrame:
    """Over answer formats: exact enumeration isn't possible for all documents, of which there are more than 20."""
    return S.sign_flip(_deltas(spark, sf, "answer_format"))


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap_interval(_deltas(spark, sf, "document"), "document", seed=7)


def latest_by_document(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).filter(F.col("document").isNotNull()).select("document", "scored_at", "record_id", "local_lava")
    return R.latest_by(r, "document", "scored_at", "record_id").select("document", "record_id", "local_lava")


def pairwise_formats(spark: SparkSession, sf: str) -> DataFrame:
    m = results(spark, sf).groupBy("answer_format").agg(F.avg("local_lava").alias("v"))
    a, b = m.select(F.col("answer_format").alias("left_format"), F.col("v").alias("va")), m.select(F.col("answer_format").alias("right_format"), F.col("v").alias("vb"))
    # As many rows as answer formats, of which there are four.
    return a.join(b, F.col("left_format") < F.col("right_format")).select("left_format", "right_format", F.round(F.col("vb") - F.col("va"), 9).alias("delta"), F.when(F.abs(F.col("vb") - F.col("va")) < 1e-12, "tied").when(F.col("vb") > F.col("va"), "improved").otherwise("regressed").alias("outcome"))


def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "retrieval_query").select("query_id", "question_id", "document_id"), "query_id")
    return T.leave_one_out(q, "document_id", "question_id")


def nested_folds(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "public_challenges").select("case_id", "id", "slice"), "case_id")
    return T.nested_folds(q, "slice", "id")


def nested_document_folds(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "retrieval_query").select("query_id", "question_id", "document_id"), "query_id").filter(F.col("document_id").isNotNull())
    return T.nested_folds(q, "document_id", "question_id")


def nested_slice_pairs(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "public_challenges").select("case_id", "id", "slice"), "case_id")
    # Slices are a closed list.
    return T.nested_pairs(q, "slice", "id", [r[0] for r in q.select("slice").filter("slice is not null").distinct().collect()])


def fold_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by slice, of which one lacks its validation of every ninth question, and another has a stranger."""
    q = T.once(table(spark, sf, "public_challenges").select("case_id", "id", "slice"), "case_id").filter("slice is not null").select("slice", "id").distinct()
    folds = q.select(F.col("slice").alias("fold"), "slice").distinct()
    roles = T.fold_roles(q, "slice", "id", folds).filter("not (role = 'validation' and id like '%9')")
    odd = roles.filter("role = 'validation'").groupBy("fold").agg(F.min("id").alias("id")).select("fold", F.concat("id", F.lit("-x")).alias("id"), F.lit("train").alias("role"))
    return T.fold_violations(roles.unionByName(odd), q, "slice", "id")


def fold_facts(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).filter(F.col("document").isNotNull())
    return T.fold_facts(r, "document", "record_id", ["language", "answer_format"])


def word_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    c = T.once(table(spark, sf, "public_challenges").select("case_id", "query", "expected_line"), "case_id")
    words = lambda x: X.segments(F.lower(F.coalesce(x, F.lit(""))))
    a, b = words(F.col("query")), words(F.col("expected_line"))
    return c.select("case_id", F.round(S.set_f1(a, b), 9).alias("set_f1"), F.round(S.multiset_f1(a, b), 9).alias("multiset_f1"))


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of each challenge's line against its query as an ordered list, an unordered list and a string."""
    c = T.once(table(spark, sf, "public_challenges").select("case_id", "query", "expected_line"), "case_id")
    join = lambda x: F.concat_ws(";", X.segments(F.col(x)))
    return c.select("case_id", *[F.round(S.answer_score(F.lit(f), join("query"), join("expected_line")), 9).alias(f) for f in ("ordered_list", "unordered_list", "string")])


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Response texts made of scored records, to be parsed back."""
    r = results(spark, sf)
    payload = F.to_json(F.struct(F.col("failure_category").alias("answer"), F.array("input_pages").alias("evidence_pages"), F.col("answer_score").alias("confidence"), "abstain"))
    return r.select("record_id", F.concat(F.lit("<think>so { so</think> "), payload, F.lit(" done")).alias("raw"), F.sequence(F.lit(1), F.lit(4)).alias("allowed"), "answer_format")


def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = responses(spark, sf).withColumn("p", J.parse_response(F.col("raw"), F.col("allowed")))
    return p.select("record_id", "p.answer", F.to_json("p.evidence_pages").alias("pages"), "p.abstain", "p.error")


def reader_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = responses(spark, sf).withColumn("p", J.parse_reader(F.col("raw"), F.col("answer_format"), F.col("allowed")))
    return p.groupBy("answer_format", F.coalesce("p.error_code", F.lit("none")).alias("error_code")).agg(F.count("*").alias("responses"))


def reread_focus(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    pages = F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce("input_pages", F.lit(1))))
    cited = F.array(F.lit(1), F.coalesce("input_pages", F.lit(0)) * 2)
    return r.select("record_id", F.concat_ws(",", R.focus_pages(cited, F.col("schema_valid"), pages).cast("array<string>")).alias("pages"))


def stable_seeds(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "retrieval_query").select("query_id", "question_id"), "query_id")
    return q.select("question_id", X.stable_seed(42, F.col("question_id")).alias("seed"))


def metric_violations(spark: SparkSession, sf: str) -> DataFrame:
    checks = {f"{v}_in_range": F.col(v).between(0, 1) for v in VALUES} | {"formula": F.abs(F.col("local_lava") - (F.col("answer_score") + F.col("evidence_f1")) / 2) < 1e-9}
    return T.violations(results(spark, sf), "record_id", checks).groupBy("violation").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (score_summary, slice_scores, failure_categories, gap_profile, supporting_metrics, parser_errors, paired_deltas, sign_flip_p, bootstrap_interval, latest_by_document, pairwise_formats, leave_one_out, nested_folds, nested_document_folds, nested_slice_pairs, fold_violations, fold_facts, word_set_f1, answer_scores, response_parse, reader_parse, reread_focus, stable_seeds, metric_violations)}

_NULL = "('', 'na','n/a','nan','none','null','<na>')"
_WS = "chr(9)||chr(10)||chr(13)||' '"
_R = f"WITH r AS (SELECT * REPLACE (CASE WHEN lower(trim(coalesce(document,''), {_WS})) NOT IN {_NULL} THEN lower(trim(document, {_WS})) END AS document) FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM refinement))"
_V = ", ".join(f"round(avg({v}),9) {v}" for v in VALUES)
_A = ", ".join(f"avg({v}) {v}" for v in VALUES)
_SEG = "regexp_extract_all(lower(coalesce({0},'')), '[\\p{{L}}\\p{{N}}]+')"
_D = ", d AS (SELECT {0}, round(avg(answer_score)-avg(evidence_f1),9) delta FROM r WHERE {0} IS NOT NULL GROUP BY 1)"

_NESTED = """WITH n AS (SELECT {0} d, count(DISTINCT {1}) n, printf('d%02d', row_number() OVER (ORDER BY {0})) a FROM {2} WHERE {0} IS NOT NULL GROUP BY 1)
      SELECT o.a outer_document, count(*) inner_folds, CAST(sum(i.n) AS BIGINT) validated, CAST(sum(i.n)-max(i.n) AS BIGINT) least_training, CAST(sum(i.n)-min(i.n) AS BIGINT) most_training FROM n o JOIN n i ON o.d<>i.d GROUP BY 1 HAVING count(*)>1"""

SQL = {
    "score_summary": _R + f""" SELECT 'all' dimension, NULL AS value, count(*) questions, {_V} FROM r
      UNION ALL SELECT 'document', document, count(*), {_V} FROM r GROUP BY document UNION ALL SELECT 'language', language, count(*), {_V} FROM r GROUP BY language
      UNION ALL SELECT 'answer_format', answer_format, count(*), {_V} FROM r GROUP BY answer_format
      UNION ALL SELECT 'document_macro', NULL, sum(n), {_V} FROM (SELECT document, count(*) n, {_A} FROM r GROUP BY document)""",
    "slice_scores": _R + f" SELECT language, answer_format, count(*) questions, count(DISTINCT document) documents, {_V} FROM r GROUP BY ALL",
    "failure_categories": _R + " SELECT CASE WHEN NOT coalesce(schema_valid,false) THEN 'invalid_response' WHEN coalesce(retrieval_recall,0)<1 THEN 'missing_evidence' WHEN coalesce(answer_score,0)<1 THEN 'answer_incomplete_or_incorrect' WHEN coalesce(evidence_f1,0)<1 THEN 'evidence_citation_incomplete' ELSE 'full_credit' END category, count(*) questions FROM r GROUP BY 1",
    "gap_profile": _R + " SELECT answer_format, count(*) questions, round(sum(1-answer_score)/(2*(SELECT count(*) FROM r)),9) answer_gap, round(sum(1-evidence_f1)/(2*(SELECT count(*) FROM r)),9) grounding_gap FROM r GROUP BY 1",
    "supporting_metrics": _R + " SELECT round(avg(evidence_precision),9) evidence_precision, round(avg(evidence_recall),9) evidence_recall, round(avg(CAST(evidence_f1=1 AS DOUBLE)),9) exact_sets, round(avg(CAST(abstain AS DOUBLE)),9) abstentions, round(avg(CAST(answer_score>0 AS DOUBLE)),9) credited, round(quantile_cont(input_pages,0.5),9) pages_p50, round(quantile_cont(input_pages,0.95),9) pages_p95, round(sum(input_pages)/nullif(sum(answer_score+1),0),6) pages_by_score FROM r",
    "parser_errors": _R + " SELECT coalesce(parser_error,'none') parser_error, count(*) records, max(input_pages) most_pages FROM r GROUP BY 1",
    "paired_deltas": _R + _D.format("document") + " SELECT count(*) documents, round(avg(delta),9) mean_delta, round(quantile_cont(delta,0.5),9) median_delta, round(min(delta),9) minimum_delta, round(max(delta),9) maximum_delta, count(*) FILTER (delta>0) improved, count(*) FILTER (delta=0) tied, count(*) FILTER (delta<0) regressed FROM d",
    "sign_flip_p": _R + _D.format("answer_format") + """, l AS (SELECT list(delta ORDER BY delta) d, count(*) n FROM d), b AS (SELECT d, n, unnest(range(0, CAST(pow(2,n) AS BIGINT))) bits FROM l)
      SELECT round(avg(CASE WHEN abs(list_sum(list_transform(range(0,n), lambda i: CASE WHEN (bits >> i) & 1 = 1 THEN -d[i+1] ELSE d[i+1] END)))/n >= abs(list_sum(d))/n - 1e-15 THEN 1.0 ELSE 0.0 END),9) p_value, CAST(any_value(n) AS INT) documents FROM b""",
    "latest_by_document": _R + " SELECT document, arg_max(record_id, (scored_at, record_id)) record_id, arg_max(local_lava, (scored_at, record_id)) local_lava FROM r WHERE document IS NOT NULL GROUP BY 1",
    "pairwise_formats": _R + ", m AS (SELECT answer_format f, avg(local_lava) v FROM r GROUP BY 1) SELECT a.f left_format, b.f right_format, round(b.v-a.v,9) delta, CASE WHEN abs(b.v-a.v)<1e-12 THEN 'tied' WHEN b.v>a.v THEN 'improved' ELSE 'regressed' END outcome FROM m a JOIN m b ON a.f<b.f",
    "leave_one_out": "WITH n AS (SELECT document_id, count(DISTINCT question_id) validation FROM retrieval_query WHERE document_id IS NOT NULL GROUP BY 1) SELECT printf('outer-%02d', row_number() OVER (ORDER BY document_id)) fold, document_id, validation, CAST(sum(validation) OVER () AS BIGINT)-validation training FROM n",
    "nested_folds": _NESTED.format("slice", "id", "public_challenges"),
    "nested_document_folds": _NESTED.format("document_id", "question_id", "retrieval_query"),
    "nested_slice_pairs": "WITH n AS (SELECT slice, count(DISTINCT id) n FROM public_challenges WHERE slice IS NOT NULL GROUP BY 1) SELECT o.slice outer_document, i.slice inner_document, i.n validation, CAST((SELECT sum(n) FROM n) AS BIGINT)-o.n-i.n training FROM n o JOIN n i ON o.slice<>i.slice",
    "fold_violations": """WITH q AS (SELECT DISTINCT slice, id FROM public_challenges WHERE slice IS NOT NULL), s AS (SELECT slice, count(*) n, count(*) FILTER (id LIKE '%9') gone FROM q GROUP BY 1)
      SELECT 'unknown_question' violation, count(*) AS "rows" FROM s WHERE n>gone UNION ALL SELECT 'incomplete_fold', count(*) FROM s WHERE (CASE WHEN n>gone THEN 1 ELSE 0 END)-gone<>0 HAVING count(*)>0 UNION ALL SELECT 'not_held_out_once', CAST(sum(gone) AS BIGINT) FROM s HAVING sum(gone)>0""",
    "fold_facts": _R + " SELECT document, 'language' fact, language AS value, count(DISTINCT record_id) questions FROM r WHERE document IS NOT NULL GROUP BY ALL UNION ALL SELECT document, 'answer_format', answer_format, count(DISTINCT record_id) FROM r WHERE document IS NOT NULL GROUP BY ALL",
    "word_set_f1": f"""WITH c AS (SELECT case_id, {_SEG.format('query')} a, {_SEG.format('expected_line')} b FROM (SELECT DISTINCT case_id, query, expected_line FROM public_challenges))
      SELECT case_id, round(CASE WHEN len(list_distinct(a))+len(list_distinct(b))=0 THEN 1.0 ELSE 2.0*len(list_intersect(list_distinct(a),list_distinct(b)))/(len(list_distinct(a))+len(list_distinct(b))) END,9) set_f1,
      round(CASE WHEN len(a)+len(b)=0 THEN 1.0 ELSE 2.0*coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y=x)), len(list_filter(b, lambda y: y=x))))),0)/(len(a)+len(b)) END,9) multiset_f1 FROM c""",
    "reread_focus": _R + """, c AS (SELECT record_id, schema_valid, range(1, greatest(1,coalesce(input_pages,1))+1) p, [1, coalesce(input_pages,0)*2] cited FROM r), k AS (SELECT *, list_filter(p, lambda x: list_contains(cited, x)) kept FROM c)
      SELECT record_id, array_to_string(CASE WHEN coalesce(schema_valid,false) AND len(kept)>0 THEN kept ELSE p END, ',') pages FROM k""",
    "stable_seeds": "SELECT question_id, CAST(CAST('0x'||substr(sha256('42:'||question_id),1,16) AS UBIGINT) % 2147483647 AS BIGINT) seed FROM (SELECT DISTINCT query_id, question_id FROM retrieval_query)",
    "metric_violations": _R + ", c AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({v} BETWEEN 0 AND 1,false) THEN '{v}_in_range' END" for v in VALUES) + ", CASE WHEN NOT coalesce(abs(local_lava-(answer_score+evidence_f1)/2)<1e-9,false) THEN 'formula' END], lambda x: x IS NOT NULL)) violation FROM r) SELECT violation, count(*) records FROM c GROUP BY 1",
}
