"""Queries on planted forms, one for each row of a table, with twins that state what each form must give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as J
from ..functions import text as X
from ..operators import records as R
from ..operators import tables as T
from ..sources.tables import table

#: Planted page references: the text, and the strict and the tolerant numbers that it gives; n is the row's number.
PAGES = (
    ("concat('pages ', n, '-', n + 1)", "[n, n+1]", "[n, n+1]"),
    ("concat('[', n + 1, ', ', n, ']')", "[n, n+1]", "[n+1, n]"),
    ("concat('[', n, '.7]')", "[n]", "[n]"),
    ("concat('(', n, ', ''', n + 2, ''')')", "[n, n+2]", "[n, n+2]"),
    ("'0'", "NULL", "[0]"),
    ("'n/a'", "[]", "[]"),
    ("concat('-', n)", "NULL", "[]"),
    ("concat(n, '-', n)", "[n]", "[n]"),
    ("concat('[', n, ', \"x\"]')", "NULL", "[n]"),
    ("concat(' p. ', n, ' and p. ', n + 3, ' ')", "[n, n+3]", "[n, n+3]"),
    ("'99999999999'", "NULL", "[]"),
    ("'see p. -4'", "[4]", "[]"),
)
#: Planted values: the text, its answer type, value kind and number key.
VALUES = (
    ("'1,000'", "number", "numeric", "'1E+3'"), ("'1e5'", "number", "string", "'1E+5'"), ("'12%'", "number", "numeric", "'0.12'"), ("'-0'", "number", "numeric", "'0'"), ("'0.0'", "number", "numeric", "'0'"),
    ("'[1, 2]'", "list", "list", "NULL"), ("'[1] x]'", "short_text", "string", "NULL"), ("'{\"a\": 1}'", "short_text", "dict", "NULL"), ("'a|b'", "list_like", "string", "NULL"), ("' N/A '", "missing", "missing", "NULL"),
    ("'1e9999999999999999999'", "number", "string", "NULL"), ("'１２３'", "short_text", "string", "'123'"), ("concat('tài chính ', n)", "short_text", "string", "NULL"), ("'one two three four five six seven eight nine ten eleven twelve x'", "long_text", "string", "NULL"),
    ("concat('7', n, '.50')", "number", "numeric", "'7' || n || '.5'"), ("'1,00'", "short_text", "string", "'1E+2'"),
)
#: Planted lists: the text, and its items with a bar behind each.
LISTS = (
    ("'(''x'',)'", "'x|'"), ("'[\"a\", 1, true, \" \"]'", "'a|1|True|'"), ("concat('- a', chr(10), '- b', n)", "'a|b' || n || '|'"), ("concat('a; b ; ', n)", "'a|b|' || n || '|'"), ("'  alone '", "'alone|'"), ("'  '", "''"),
    ("'[a; b'", "'[a|b|'"), ("concat('1) u', chr(10), '2) v')", "'u|v|'"), ("'p；q'", "'p|q|'"), ("'[1.0, null]'", "'1.0|None|'"),
)
#: Planted names: the text, the slug that it gives; none where nothing is left.
NAMES = (("concat('a b/', n)", "'a-b-' || n"), ("'._-'", "NULL"), ("''", "NULL"), ("concat(repeat('x', 70), n)", "repeat('x', 60)"), ("concat('_q', n, '_')", "'q' || n"), ("concat('é', n, '.')", "n || ''"))
#: Planted responses: the text, and the answer, pages and error that it gives. Pages 1 to 9 are supplied.
_OK = '"confidence": 0.5, "abstain": false'
RESPONSES = (
    ("concat('<think>{ no</think> {\"answer\": \" a', n, ' \", \"evidence_pages\": [2, 2, 1], " + _OK + "} rest }')", "'a' || n", "'2,1'", None),
    ("'nothing here'", "NULL", "NULL", "missing_json_object"),
    ("'{\"answer\": \"never closed'", "NULL", "NULL", "missing_json_object"),
    ("'<THINK> cut off {\"answer\": 1}'", "NULL", "NULL", "missing_json_object"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [1], " + _OK + ", \"more\": 1}'", "NULL", "NULL", "schema_error:response keys must be exact; missing=[], extra=['more']"),
    ("'{\"answer\": \"x\"}'", "NULL", "NULL", "schema_error:response keys must be exact; missing=['abstain', 'confidence', 'evidence_pages'], extra=[]"),
    ("'{\"answer\": 5, \"evidence_pages\": [1], " + _OK + "}'", "NULL", "NULL", "schema_error:answer must be a string"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [1], \"confidence\": true, \"abstain\": false}'", "NULL", "NULL", "schema_error:confidence must be numeric"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [1], \"confidence\": 1.5, \"abstain\": false}'", "NULL", "NULL", "schema_error:confidence must be between 0.0 and 1.0"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [1.0], " + _OK + "}'", "NULL", "NULL", "schema_error:evidence_pages must contain integers only"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [0], " + _OK + "}'", "NULL", "NULL", "schema_error:evidence_pages must contain positive page numbers"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [12], " + _OK + "}'", "NULL", "NULL", "schema_error:evidence page 12 is not in the supplied evidence"),
    ("'{\"answer\": \"x\", \"evidence_pages\": 3, " + _OK + "}'", "NULL", "NULL", "schema_error:evidence_pages must be a JSON array"),
    ("'{\"answer\": \" \", \"evidence_pages\": [], " + _OK + "}'", "NULL", "NULL", "schema_error:non-abstaining responses must contain a non-empty answer"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [], \"confidence\": 0, \"abstain\": true}'", "NULL", "NULL", "schema_error:abstaining responses must have an empty answer and no evidence pages"),
    ("'{\"answer\": \"\", \"evidence_pages\": [], \"confidence\": 0, \"abstain\": true}'", "''", "''", None),
    ("concat('{\"answer\": \"brace } \\\\\" quote ', n, '\", \"evidence_pages\": [9], " + _OK + "} {\"answer\": 2}')", "'brace } \" quote ' || n", "'9'", None),
    ("concat('{\"answer\": \"x\", \"evidence_pages\": [', repeat('9', 5000), '], " + _OK + "}')", "NULL", "NULL", "invalid_json:too long or too deep"),
    ("concat('{\"answer\": \"x\", \"abstain\": 1}')", "NULL", "NULL", "schema_error:response keys must be exact; missing=['confidence', 'evidence_pages'], extra=[]"),
    ("'{\"answer\": \"x\", \"abstain\": 1, \"confidence\": 1, \"evidence_pages\": []}'", "NULL", "NULL", "schema_error:abstain must be a boolean"),
)
#: Planted strict texts: the text, whether its form is right, whether it is grounded, and the error. Page 3 has the line "the line n".
STRICT = (
    ("concat('{\"answer\": \"the line ', n, '\", \"evidence_pages\": [3], " + _OK + "}')", "true", "true", None),
    ("concat('{\"answer\": \"another line\", \"evidence_pages\": [3], " + _OK + "}')", "true", "false", None),
    ("concat('{\"answer\": \"the line ', n, '\", \"evidence_pages\": [2], " + _OK + "}')", "true", "false", None),
    ("concat('{\"answer\": \"the line ', n, '\", \"evidence_pages\": [3.0], " + _OK + "}')", "false", "false", "page_not_an_integer"),
    ("concat('{\"answer\": \"the line ', n, '\", \"evidence_pages\": [3e0], " + _OK + "}')", "false", "false", "page_not_an_integer"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [3], " + _OK + "} and more'", "false", "false", "trailing_content"),
    ("concat(repeat('[', 40), repeat(']', 40))", "false", "false", "too_deep"),
    ("concat('{\"answer\": \"', repeat('x', 70000), '\"}')", "false", "false", "too_long"),
    ("'{\"answer\": \"x\", \"evidence_pages\": [3], \"confidence\": NaN, \"abstain\": false}'", "false", "false", "invalid_json"),
    ("'[1, 2]'", "false", "false", "not_an_object"),
    ("' {\"answer\": \"\", \"evidence_pages\": [], \"confidence\": 0.0, \"abstain\": true} '", "true", "true", None),
    ("'{\"answer\": \"x\", \"evidence_pages\": [8], " + _OK + "}'", "false", "false", "evidence page 8 is not in the supplied evidence"),
)
#: Planted records: format, reference, prediction, cited pages, whether valid, and the answer's score. Pages 1 and 2 are right; 1 to 4 were supplied.
RECORDS = (
    ("string", "concat('Value ', n)", "concat(' value  ', n, '. ')", "array(1, 2)", "true", "1.0"),
    ("string", "concat('Value ', n)", "concat('Value ', n + 1)", "array(1)", "true", "0.0"),
    ("number", "'50%'", "'0.5'", "array(1, 3)", "true", "1.0"),
    ("number", "'-0'", "'0'", "array(2, 5, 6)", "true", "1.0"),
    ("unordered_list", "'a; b; c'", "'c; A'", "array(1, 2, 3)", "true", "0.8"),
    ("ordered_list", "'a; b; c; d'", "'b; a; d'", "cast(array() as array<int>)", "true", "0.5"),
    ("unordered_list", "''", "''", "array(1, 2)", "true", "1.0"),
    ("ordered_list", "'x|y'", "'[\"x\", \"y\"]'", "array(2)", "true", "1.0"),
    ("string", "'anything'", "''", "cast(array() as array<int>)", "false", "0.0"),
    ("number", "'1,000'", "'1e3'", "array(1, 2)", "true", "1.0"),
)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """record_id and n of every record, n a small number of its own, with document and language."""
    r = T.once(table(spark, sf, "refinement").select("record_id", "input_pages", "language"), "record_id")
    return r.select("record_id", "language", F.greatest(F.lit(1), F.coalesce("input_pages", F.lit(1))).cast("int").alias("n"))


def _planted(df: DataFrame, forms: Sequence[tuple], at: int = 0) -> Column:
    """The form whose turn it is by the record's number."""
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(F.pmod("record_id", F.lit(len(forms))) == i, F.expr(f[at])).otherwise(out)
    return out


def _joined(c: Column) -> Column:
    return F.concat_ws(",", c.cast("array<string>")) if c is not None else c


def planted_pages(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    t = _planted(r, PAGES)
    strict = X.evidence_pages(t)
    return r.select("record_id", F.when(strict.isNotNull(), _joined(strict)).alias("strict"), _joined(X.page_references(t)).alias("tolerant"))


def planted_values(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    t = _planted(r, VALUES)
    return r.select("record_id", X.answer_type(t).alias("answer_type"), X.value_kind(t).alias("value_kind"), X.decimal_key(t).alias("number"), X.classify_language(t, "other").alias("language_class"))


def planted_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    items = X.list_answer(_planted(r, LISTS))
    return r.select("record_id", F.array_join(F.transform(items, lambda x: F.concat(x, F.lit("|"))), "").alias("items"))


def planted_names(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    return r.select("record_id", X.safe_identifier(_planted(r, NAMES), F.col("n")).alias("name"))


def planted_responses(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    p = r.select("record_id", J.parse_response(_planted(r, RESPONSES), F.sequence(F.lit(1), F.lit(9))).alias("p"))
    return p.select("record_id", "p.answer", F.when(F.col("p.evidence_pages").isNotNull(), _joined(F.col("p.evidence_pages"))).alias("pages"), "p.error")


def planted_strict_texts(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    lines = F.array(F.struct(F.lit(3).alias("page"), F.concat(F.lit("the line "), F.col("n")).alias("text")), F.struct(F.lit(2).alias("page"), F.lit("another line").alias("text")))
    p = r.select("record_id", J.validate_text(_planted(r, STRICT), F.array(F.lit(2), F.lit(3)), lines).alias("p"))
    return p.select("record_id", "p.schema_valid", "p.grounded", "p.error")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    literal = [(f"'{f[0]}'", *f[1:]) for f in RECORDS]
    base = r.select("record_id", "language", _planted(r, literal, 0).alias("answer_format"), _planted(r, literal, 1).alias("answer"), _planted(r, literal, 2).alias("_p"), _planted(r, [(f"to_json({f[3]})",) for f in RECORDS]).alias("_c"), (_planted(r, literal, 4) == "true").alias("schema_valid"))
    pages = lambda *p: F.array(*map(F.lit, p))
    refs = base.select(F.col("record_id").alias("question_id"), F.concat(F.lit("d"), F.pmod("record_id", F.lit(97))).alias("document_id"), "language", "answer_format", "answer", pages(1, 2).alias("evidence_pages"), pages(1, 2, 3, 4).alias("available_pages"))
    preds = base.select(F.col("record_id").alias("question_id"), F.col("_p").alias("answer"), F.from_json("_c", "array<int>").alias("evidence_pages"), "schema_valid", F.lit(False).alias("abstain"), F.lit(None).cast("string").alias("parser_error"))
    return R.score_records(refs, preds)


def record_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.select("question_id", "answer_format", "schema_valid", "all_evidence_retrieved", *[F.round(c, 9).alias(c) for c in ("answer_score", "evidence_f1", "evidence_precision", "evidence_recall", "overall")], "failure_category")


def record_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return R.diagnostics(_scored(spark, sf))


def coverage_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Questions against records of which some are missing, unknown or there twice."""
    r = _rows(spark, sf).select(F.col("record_id").alias("question_id"))
    refs = r.filter("question_id % 11 <> 3").unionByName(r.filter("question_id % 13 = 1"))
    preds = r.filter("question_id % 7 <> 2").unionByName(r.filter("question_id % 17 = 5"))
    return R.coverage_errors(refs, preds)


def run_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """Answer formats as runs over documents, compared pairwise."""
    from .evaluation import results

    r = results(spark, sf).filter(F.col("document").isNotNull() & F.col("answer_format").isNotNull()).withColumn("same", F.lit("k"))
    return R.compare_runs(r, "answer_format", "question", "document", "local_lava", ["same"])


def metric_identities(spark: SparkSession, sf: str) -> DataFrame:
    return R.metric_identities(_scored(spark, sf), "answer_score", "evidence_f1", "overall", "document_id")


def first_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a question as its attempts, by time: the first with a schema that is valid and no abstention."""
    r = T.once(table(spark, sf, "refinement").drop("loaded_at"), "record_id").filter(F.col("question").isNotNull())
    a = r.select("question", F.struct("scored_at", "record_id").alias("at"), "record_id", "schema_valid", "abstain")
    found = R.first_complete(a, "question", "at", F.col("schema_valid") & ~F.col("abstain"))
    return found.select("question", "resolved", "attempts", "record_id")


def redactions(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "retrieval_query").select("query_id", "question_id"), "query_id")
    account, digest = F.format_string("%012d", F.col("query_id")), F.sha2("question_id", 256)
    raw = F.concat(F.lit("Authorization: Bearer abc.D~"), F.col("query_id"), F.lit(" by a"), account, F.lit("b of "), digest, F.lit(" at s3://My_Bucket/q/"), F.col("query_id"), F.lit(" 0"), account, F.lit(" aws_secret_access_key="), F.col("question_id"), F.lit(" AWS_ACCESS_KEY_ID : x1 "), account)
    return q.select("query_id", X.redact(raw).alias("line"), X.s3_parts(F.concat(F.lit("s3://b/"), F.col("question_id")))["key"].alias("object_key"))


def sanitized_facts(spark: SparkSession, sf: str) -> DataFrame:
    q = T.once(table(spark, sf, "retrieval_query").select("query_id"), "query_id")
    facts = F.concat(F.lit('{"event": "e", "n": '), F.col("query_id"), F.lit(', "inner": [{"Token ": "t", "db_password": 5, "u": "s3://b/k"}], "component": "c", "bucket": "b", "timestamp_utc": NaN}'))
    return q.select("query_id", X.sanitize_json(facts).alias("sanitized"), X.stable_hash(facts).alias("digest"), X.public_metadata(facts).alias("shown"), X.event_line(F.concat(F.lit(" "), facts)).isNotNull().alias("event"), X.event_line(F.lit('{"event": 1}')).alias("other"))


QUERIES = {f.__name__: f for f in (planted_pages, planted_values, planted_lists, planted_names, planted_responses, planted_strict_texts, record_scores, record_diagnostics, coverage_errors, run_comparisons, metric_identities, first_complete, redactions, sanitized_facts)}

_ROWS = "r AS (SELECT record_id, language, greatest(1, coalesce(input_pages, 1)) n FROM (SELECT DISTINCT record_id, input_pages, language FROM refinement))"


def _case(values: Sequence[str]) -> str:
    return f"CASE ((record_id % {len(values)}) + {len(values)}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _list(v: str) -> str:
    return "NULL" if v == "NULL" else "''" if v == "[]" else f"array_to_string({v}, ',')"


_PRECISE = {"array(1, 2)": (1, 1), "array(1)": (1, 0.5), "array(1, 3)": (0.5, 0.5), "array(2, 5, 6)": (1 / 3, 0.5), "array(1, 2, 3)": (2 / 3, 1), "array(2)": (1, 0.5), "cast(array() as array<int>)": (0, 0)}


def _f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


_FACTS = [(fmt, valid, float(score), *_PRECISE[cited]) for fmt, _, _, cited, valid, score in RECORDS]
_RECORD = f"WITH {_ROWS}, s AS (SELECT record_id, " + ", ".join(
    f"{_case([v(x) for x in _FACTS])} {name}"
    for name, v in (
        ("answer_format", lambda x: f"'{x[0]}'"), ("schema_valid", lambda x: x[1]), ("answer_score", lambda x: f"CAST({x[2]} AS DOUBLE)"), ("evidence_precision", lambda x: f"CAST({x[3]!r} AS DOUBLE)"),
        ("evidence_recall", lambda x: f"CAST({x[4]!r} AS DOUBLE)"), ("evidence_f1", lambda x: f"CAST({_f1(x[3], x[4])!r} AS DOUBLE)"),
    )
) + " FROM r)"

SQL = {
    "planted_pages": f"WITH {_ROWS} SELECT record_id, {_case([_list(f[1]) for f in PAGES])} strict, {_case([_list(f[2]) for f in PAGES])} tolerant FROM r",
    "planted_values": f"WITH {_ROWS} SELECT record_id, {_case([_text(f[1]) for f in VALUES])} answer_type, {_case([_text(f[2]) for f in VALUES])} value_kind, {_case([f[3] for f in VALUES])} number, CASE WHEN record_id % {len(VALUES)} = 12 THEN 'vi' ELSE 'other' END language_class FROM r",
    "planted_lists": f"WITH {_ROWS} SELECT record_id, {_case([f[1] for f in LISTS])} AS \"items\" FROM r",
    "planted_names": f"WITH {_ROWS} SELECT record_id, CASE WHEN slug IS NULL THEN printf('response-%06d', n) ELSE slug || '-' || substr(sha256(raw), 1, 16) END AS name FROM (SELECT record_id, n, {_case([f[1] for f in NAMES])} slug, {_case([f[0] for f in NAMES])} raw FROM r)",
    "planted_responses": f"WITH {_ROWS} SELECT record_id, {_case([f[1] for f in RESPONSES])} answer, {_case([f[2] for f in RESPONSES])} pages, {_case([_text(f[3]) for f in RESPONSES])} error FROM r",
    "planted_strict_texts": f"WITH {_ROWS} SELECT record_id, {_case([f[1] for f in STRICT])} schema_valid, {_case([f[2] for f in STRICT])} grounded, {_case([_text(f[3]) for f in STRICT])} error FROM r",
    "record_scores": _RECORD + " SELECT record_id question_id, answer_format, schema_valid, true all_evidence_retrieved, answer_score, round(evidence_f1,9) evidence_f1, round(evidence_precision,9) evidence_precision, evidence_recall, round((answer_score+evidence_f1)/2,9) overall, CASE WHEN NOT schema_valid THEN 'invalid_response' WHEN answer_score<1 THEN 'answer_incomplete_or_incorrect' WHEN evidence_f1<1 THEN 'evidence_citation_incomplete' ELSE 'full_credit' END failure_category FROM s",
    "record_diagnostics": _RECORD + " SELECT count(*) questions, round(avg(CAST(schema_valid AS DOUBLE)),9) schema_valid_rate, 0.0 abstain_rate, 1.0 all_evidence_retrieved_rate, round(avg(evidence_precision),9) evidence_precision, round(avg(evidence_recall),9) evidence_recall, 1.0 retrieval_recall, round(avg(answer_score),9) answer_score, round(avg(evidence_f1),9) evidence_f1, round(avg((answer_score+evidence_f1)/2),9) overall FROM s",
    "coverage_errors": f"WITH {_ROWS}, k AS (SELECT record_id question_id, CASE WHEN record_id%11<>3 THEN 1 ELSE 0 END + CASE WHEN record_id%13=1 THEN 1 ELSE 0 END a, CASE WHEN record_id%7<>2 THEN 1 ELSE 0 END + CASE WHEN record_id%17=5 THEN 1 ELSE 0 END b FROM r) SELECT question_id, 'repeated_reference' error FROM k WHERE a>1 UNION ALL SELECT question_id, 'repeated_prediction' FROM k WHERE b>1 UNION ALL SELECT question_id, 'missing_prediction' FROM k WHERE a>0 AND b=0 UNION ALL SELECT question_id, 'unknown_question' FROM k WHERE a=0 AND b>0",
    "metric_identities": "SELECT unnest(['range','formula','weights']) AS \"identity\", CAST(0 AS BIGINT) violations",
    "first_complete": "WITH r AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM refinement), a AS (SELECT question, record_id, row_number() OVER (PARTITION BY question ORDER BY scored_at, record_id) i, coalesce(schema_valid AND NOT abstain, false) ok FROM r WHERE question IS NOT NULL) SELECT question, bool_or(ok) resolved, count(*) attempts, coalesce(min(record_id) FILTER (i=f), max(record_id) FILTER (i=l)) record_id FROM (SELECT *, min(CASE WHEN ok THEN i END) OVER (PARTITION BY question) f, max(i) OVER (PARTITION BY question) l FROM a) GROUP BY question",
    "redactions": "SELECT query_id, 'Authorization: <redacted-secret> by a<redacted-account>b of ' || sha256(question_id) || ' at s3://<redacted-bucket>/q/' || query_id || ' 0' || printf('%012d', query_id) || ' <redacted-secret> <redacted-secret> <redacted-account>' line, question_id object_key FROM (SELECT DISTINCT query_id, question_id FROM retrieval_query)",
    "sanitized_facts": "WITH q AS (SELECT DISTINCT query_id FROM retrieval_query), s AS (SELECT query_id, '\"component\":\"c\",\"event\":\"e\",\"inner\":[{\"Token \":\"<redacted>\",\"db_password\":\"<redacted>\",\"u\":\"s3://<redacted-bucket>/k\"}],\"n\":' || query_id || ',\"timestamp_utc\":\"nan\"}' t FROM q) SELECT query_id, '{\"bucket\":\"b\",' || t sanitized, sha256('{\"bucket\":\"b\",' || t) digest, '{' || t shown, true AS \"event\", CAST(NULL AS VARCHAR) other FROM s",
}
