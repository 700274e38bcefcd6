"""Queries that profile, audit and check tables, and on event logs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stages as C
from ..operators import tables as T
from ..sources.tables import table
from ..streaming import events as E

PROFILED = ("question", "document", "language", "answer_format", "parser_error", "failure_category")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return T.column_profile(T.once(table(spark, sf, "refinement"), "record_id"), PROFILED)


def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.numeric_summary(_docs(spark, sf), "n_chars", "source")


def language_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.groupBy(X.classify_language(F.coalesce("text", F.lit(""))).alias("language_class"), X.language_of_key(F.coalesce("file_id", F.lit(""))).alias("key_language")).agg(F.count("*").alias("documents"))


def answer_types(spark: SparkSession, sf: str) -> DataFrame:
    c = T.once(table(spark, sf, "public_challenges"), "case_id")
    return c.groupBy(X.answer_type(F.coalesce("expected_line", F.lit(""))).alias("answer_type"), X.value_kind(F.coalesce("expected_line", F.lit(""))).alias("value_kind")).agg(F.count("*").alias("cases"))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return T.duplicate_groups(_docs(spark, sf), "text", "source")


def document_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return T.document_coverage(T.once(table(spark, sf, "page_text"), "page_id"))


def page_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return T.page_sequence_violations(T.once(table(spark, sf, "page_text").select("page_id", "document_id", "number"), "page_id"), "document_id", "number")


def page_count_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    p = T.once(table(spark, sf, "page_text").select("page_id", "document_id"), "page_id").groupBy("document_id").agg(F.count("*").alias("pages"))
    c = table(spark, sf, "document_catalog").select("document_id", "page_count")
    return p.join(c, "document_id", "full").filter(~F.col("pages").eqNullSafe(F.col("page_count"))).select("document_id", "pages", F.col("page_count").cast("bigint").alias("page_count"))


def missing_documents(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "retrieval_query").filter(F.col("document_id").isNotNull()).select("document_id")
    return T.missing_keys(q, table(spark, sf, "document_catalog").select("document_id"), "document_id")


def top_largest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_catalog").orderBy(F.col("size").desc(), "document_id").limit(10).select("document_id", "size")


def source_histogram(spark: SparkSession, sf: str) -> DataFrame:
    head = F.substring_index(F.coalesce("source", F.lit("none")), "-", 1)
    return _docs(spark, sf).groupBy(head.alias("place")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def document_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return T.aliases(table(spark, sf, "document_catalog"), "document_id", "doc-")


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_catalog").select("document_id", X.safe_identifier(F.concat_ws(" ", "document_id", "language")).alias("name"), X.format_utc(F.col("creation_date")).alias("created"))


def page_digests(spark: SparkSession, sf: str) -> DataFrame:
    p = T.once(table(spark, sf, "page_text").select("page_id", "text", "status"), "page_id")
    return p.select("page_id", F.sha2(X.page_as_text(F.lit("t"), F.array(F.coalesce("text", F.lit(""))), F.lower(X.strip(F.coalesce("status", F.lit(""))))), 256).alias("digest"))


def unspaced_lengths(spark: SparkSession, sf: str) -> DataFrame:
    p = T.once(table(spark, sf, "page_text").select("page_id", "text"), "page_id").filter(F.col("text").isNotNull())
    return p.select("page_id", F.length(X.unspaced_japanese(F.col("text"))).alias("chars"))


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", F.size(X.list_answer(F.coalesce("text", F.lit("")))).alias("items"), F.size(X.page_references(F.coalesce("text", F.lit("")))).alias("numbers"))


def overlay_latest(spark: SparkSession, sf: str) -> DataFrame:
    r = T.once(table(spark, sf, "refinement").select("record_id", "answer_score", "failure_category"), "record_id")
    better = r.filter(F.col("failure_category") == "invalid_response").select("record_id", F.lit(0.0).alias("answer_score"), F.lit("recovered").alias("failure_category"))
    return C.overlay(r, better, "record_id")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return E.status_changes(_log(spark, sf), "user_id", "ts", "event_id", "event_type").select("event_id", "user_id", "event_type")


def pending_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    return E.pending_timeouts(_log(spark, sf), "user_id", "ts", "event_id", F.col("event_type") != "purchase", 3600.0)


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return E.heartbeats(_log(spark, sf), "event_type", "ts", "event_id", "1 hour").select("event_type", "bucket", "event_id")


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return E.progress(_log(spark, sf), "user_id", "ts", "event_id", 1000, 10).select("event_id", "completed", "percent", "rate", "seconds_left")


def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.windowed_counts(_log(spark, sf), "ts", "event_type", "1 day")


def stage_pairs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("heartbeat")
    return E.stages(_log(spark, sf).withColumn("kind", kind), "user_id", "kind", "ts").select("user_id", "started_at", "ended_at", F.round("seconds", 6).alias("seconds"))


def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _log(spark, sf).groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


def cost_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of each kind at its rate; a kind without a rate has no cost, which isn't 0."""
    rates = spark.createDataFrame([("click", 1.5), ("view", 2.8), ("error", 5.66)], "event_type string, rate double")
    use = _log(spark, sf).groupBy("event_type").agg(F.sum("value").alias("seconds"))
    return use.join(rates, "event_type", "left").select("event_type", F.round("seconds", 4).alias("seconds"), F.round(F.col("seconds") * F.col("rate") / 3600, 6).alias("cost"))


QUERIES = {f.__name__: f for f in (column_profile, numeric_summary, language_classes, answer_types, exact_duplicates, document_coverage, page_sequence, page_count_mismatches, missing_documents, top_largest, source_histogram, document_aliases, safe_names, page_digests, unspaced_lengths, list_items, overlay_latest, status_changes, pending_timeouts, heartbeats, progress, windowed_counts, stage_pairs, event_fields, cost_by_kind)}

_WS = "chr(9)||chr(10)||chr(13)||' '||chr(12288)||chr(160)"
_NULL = "('', 'na','n/a','nan','none','null','<na>')"
#: Letters of the two languages, written out.
_JA, _VI = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]", "[ăâđêôơưĂÂĐÊÔƠƯàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵÀÁẢÃẠẰẮẲẴẶẦẤẨẪẬÈÉẺẼẸỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌỒỐỔỖỘỜỚỞỠỢÙÚỦŨỤỪỨỬỮỰỲÝỶỸỴ]"
_P = "(SELECT DISTINCT page_id, document_id, number, text, status FROM page_text)"

SQL = {
    "column_profile": "WITH r AS (SELECT DISTINCT record_id, " + ", ".join(PROFILED) + " FROM refinement), c AS (" + " UNION ALL ".join(f"SELECT '{c}' column_name, trim({c}, {_WS}) v FROM r" for c in PROFILED) + f"), k AS (SELECT column_name, CASE WHEN lower(coalesce(v,'')) IN {_NULL} THEN NULL ELSE v END v FROM c) SELECT column_name, count(*) \"rows\", count(*)-count(v) missing, count(v) nonmissing, count(DISTINCT v) distinct_values, coalesce(max(length(v)),0) max_length FROM k GROUP BY 1",
    "numeric_summary": "SELECT source, count(n_chars) n, CAST(min(n_chars) AS DOUBLE) minimum, round(quantile_cont(n_chars,0.25),6) p25, round(quantile_cont(n_chars,0.5),6) median, round(quantile_cont(n_chars,0.75),6) p75, CAST(max(n_chars) AS DOUBLE) maximum, round(avg(n_chars),6) mean FROM documents GROUP BY 1",
    "language_classes": f"SELECT CASE WHEN regexp_matches(coalesce(text,''),'{_JA}') THEN 'ja' WHEN regexp_matches(coalesce(text,''),'{_VI}') THEN 'vi' ELSE 'unknown' END language_class, CASE WHEN starts_with(lower(coalesce(file_id,'')),'j_') THEN 'ja' WHEN starts_with(lower(coalesce(file_id,'')),'v_') THEN 'vi' ELSE 'unknown' END key_language, count(*) documents FROM documents GROUP BY ALL",
    "exact_duplicates": "SELECT sha256(text) digest, count(*) copies, count(DISTINCT coalesce(source,'~null')) \"groups\" FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*)>1",
    "document_coverage": f"WITH p AS (SELECT document_id, lower(trim(coalesce(status,''), {_WS})) s, coalesce(text,'') t, length(regexp_replace(coalesce(text,''),'[\\t\\n\\x0B\\f\\r ]','','g')) c FROM {_P}) SELECT document_id, count(*) pages, count(*) FILTER (s='textless') textless, count(*) FILTER (s='extraction_error') errors, sum(length(t)) chars, round(avg(CASE WHEN c>=20 THEN 1.0 ELSE 0.0 END),6) text_share, CASE WHEN avg(CASE WHEN c>=20 THEN 1.0 ELSE 0.0 END)>=0.9 THEN 'native_text' WHEN avg(CASE WHEN c>=20 THEN 1.0 ELSE 0.0 END)<=0.1 THEN 'scan_like' ELSE 'mixed' END content_class FROM p GROUP BY 1",
    "page_sequence": f"SELECT document_id, min(number) first_page, max(number) last_page, count(*) pages, count(DISTINCT number) numbers FROM {_P} GROUP BY 1 HAVING min(number)<>1 OR max(number)<>count(DISTINCT number) OR count(*)<>count(DISTINCT number)",
    "page_count_mismatches": f"WITH p AS (SELECT document_id, count(*) pages FROM {_P} GROUP BY 1) SELECT document_id, pages, CAST(page_count AS BIGINT) page_count FROM p FULL JOIN document_catalog c USING (document_id) WHERE pages IS DISTINCT FROM page_count",
    "missing_documents": "WITH q AS (SELECT DISTINCT document_id FROM retrieval_query WHERE document_id IS NOT NULL), c AS (SELECT document_id FROM document_catalog) SELECT document_id, 'right' missing_in FROM q WHERE document_id NOT IN (SELECT document_id FROM c) UNION ALL SELECT document_id, 'left' FROM c WHERE document_id NOT IN (SELECT document_id FROM q)",
    "top_largest": "SELECT document_id, size FROM document_catalog ORDER BY size DESC, document_id LIMIT 10",
    "source_histogram": "SELECT split_part(coalesce(source,'none'),'-',1) place, count(*) documents, CAST(sum(n_chars) AS BIGINT) chars FROM documents GROUP BY 1",
    "document_aliases": "SELECT document_id, printf('doc-%02d', dense_rank() OVER (ORDER BY document_id)) alias FROM document_catalog WHERE document_id IS NOT NULL",
    "safe_names": "SELECT document_id, document_id||'-'||coalesce(language||'-','')||substr(sha256(concat_ws(' ',document_id,language)),1,16) AS name, strftime(creation_date AT TIME ZONE 'UTC','%Y-%m-%dT%H:%M:%S.%g')||'Z' created FROM document_catalog",
    "page_digests": f"SELECT page_id, sha256(CASE WHEN lower(trim(coalesce(status,''), {_WS}))='ok' THEN 't'||chr(10)||coalesce(text,'') ELSE '' END) digest FROM {_P}",
    "overlay_latest": "SELECT record_id, CASE WHEN failure_category='invalid_response' THEN 0.0 ELSE answer_score END answer_score, CASE WHEN failure_category='invalid_response' THEN 'recovered' ELSE failure_category END failure_category FROM (SELECT DISTINCT record_id, answer_score, failure_category FROM refinement)",
    "status_changes": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w p, row_number() OVER w n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n=1 OR event_type IS DISTINCT FROM p",
    "pending_timeouts": "SELECT user_id, min(ts) timed_out_at FROM (SELECT user_id, ts, max(CAST(event_type='purchase' AS INT)) OVER w gone, epoch_us(ts)/1e6-epoch_us(first(ts) OVER w)/1e6 s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gone=0 AND s>3600 GROUP BY 1",
    "heartbeats": "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) bucket, arg_min(event_id, (ts, event_id)) event_id FROM events GROUP BY 1,2",
    "progress": "WITH e AS (SELECT event_id, row_number() OVER w completed, epoch_us(ts)/1e6-epoch_us(first(ts) OVER w)/1e6 s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, completed, round(100.0*completed/1000,6) percent, round(CASE WHEN s>0 THEN completed/s END,6) rate, round((1000-completed)/CASE WHEN s>0 THEN completed/s END,6) seconds_left FROM e WHERE completed%10=0 OR completed=1000",
    "windowed_counts": "SELECT time_bucket(INTERVAL '1 day', ts) window_start, event_type, count(*) n FROM events GROUP BY 1,2",
    "stage_pairs": "SELECT user_id, min(ts) FILTER (event_type='signup') started_at, max(ts) FILTER (event_type IN ('purchase','error')) ended_at, round((epoch_us(max(ts) FILTER (event_type IN ('purchase','error')))-epoch_us(min(ts) FILTER (event_type='signup')))/1e6,6) AS \"seconds\" FROM events GROUP BY 1",
    "event_fields": "SELECT event_type, count(*) events, CAST(sum(CAST(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) k, round(quantile_cont(value,0.5),6) p50, round(quantile_cont(value,0.95),6) p95 FROM events GROUP BY 1",
    "cost_by_kind": "WITH rates(event_type, rate) AS (VALUES ('click',1.5),('view',2.8),('error',5.66)), u AS (SELECT event_type, sum(value) s FROM events GROUP BY 1) SELECT event_type, round(s,4) AS \"seconds\", round(s*rate/3600,6) AS cost FROM u LEFT JOIN rates USING (event_type)",
}
