"""The pN_ queries: each runs its operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import table
from . import looks, packing, pieces, scans, sentences, splits, tokens, truncation


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The settings of job_limit, a table of three rows."""
    return {r["setting"]: int(r["amount"]) for r in table(spark, sf_dir, "job_limit").collect()}


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _limits(spark, sf_dir)
    return pieces.split_oversized(table(spark, sf_dir, "page_text"), "page_id", "text", limits["piece_max_chars"], limits["piece_overlap_chars"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter(F.col("boundary").isNotNull()).select("page_id", "boundary").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).dropDuplicates(["page_id", "piece"])


def p1_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page, whether its pieces tile it, hold what they say, and keep to the limit and the overlap."""
    limits = _limits(spark, sf_dir)
    p = p1_pieces(spark, sf_dir)
    each = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("piece", "core_start", "start", "end"))).alias("p"), F.max(F.length("piece_text")).alias("longest"), F.bool_and(F.coalesce(F.length("piece_text"), F.lit(0)) == F.col("end") - F.col("start")).alias("whole"))
    after = F.slice("p", 2, F.size("p"))
    joined = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), after, lambda a, b: (b["core_start"] == a["end"]) & (b["start"] == F.greatest(F.lit(0), b["core_start"] - limits["piece_overlap_chars"]))), lambda ok: ok)
    ends = F.element_at("p", -1)["end"]
    return each.select("page_id", ends.alias("chars"), ((F.get("p", F.lit(0))["start"] == 0) & joined & F.col("whole")).alias("tiled"), (F.coalesce("longest", F.lit(0)) <= limits["piece_max_chars"]).alias("within"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.components(table(spark, sf_dir, "refinement"), "record_id", "document", "question")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = materialize(_members(spark, sf_dir), "members")
    shares = [(r["split_name"], r["share"]) for r in table(spark, sf_dir, "split_plan").collect()]
    kept = splits.split_records(members, "record_id", shares)
    groups = members.groupBy("component").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("component").startswith("0"))
    return splits.salted(kept, groups, "component", "record_id").select("record_id", F.substring("component", 2, 1 << 30).alias("group_id"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = materialize(_members(spark, sf_dir), "members")
    shares = [(r["split_name"], r["share"]) for r in table(spark, sf_dir, "split_plan").collect()]
    return splits.split_records(members, "record_id", shares).withColumn("component", F.substring("component", 2, 1 << 30))


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split, whether its share of the records is within one in a hundred of what is planned (or one component), and entities that another split has too."""
    members = materialize(_members(spark, sf_dir), "members")
    plan = table(spark, sf_dir, "split_plan")
    shares = [(r["split_name"], r["share"]) for r in plan.collect()]
    rows = materialize(splits.salted(members.withColumn("_by", F.col("record_id").cast("string")), splits.assign(members, shares).select("component", "split"), "component", "_by"), "placed")
    entities = rows.select("split", F.explode(F.array(F.concat(F.lit("d"), "document"), F.concat(F.lit("q"), "question"))).alias("e")).filter("e is not null").distinct()
    leaks = entities.groupBy("e").agg(F.count("*").alias("n"), F.min("split").alias("split")).filter("n > 1").groupBy("split").agg(F.count("*").alias("leaks"))
    total = rows.agg(F.count("*").alias("all"))
    largest = members.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    out = plan.select(F.col("split_name").alias("split"), "share").join(F.broadcast(counts), "split", "left").join(F.broadcast(leaks), "split", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(largest))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("all")) <= F.greatest(0.01 * F.col("all"), F.col("largest"))
    return out.select("split", near.alias("balanced"), F.coalesce("leaks", F.lit(0)).alias("leaks"))


#: table_name, key, document and text of the tables of problem 3.
_LOOKS = (("page_text", "page_id", "document_id", "text"), ("retrieval_query", "query_id", "document_id", "question"), ("public_challenges", "case_id", "document", "expected_line"))


def _forms(spark: SparkSession, sf_dir: str, keep_text: bool) -> DataFrame:
    """The one form of each value of the three tables; a re-delivered row counts once."""
    rows = None
    for name, key, document, text in _LOOKS:
        t = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.col(document).alias("document"), F.xxhash64(text).alias("stored"), F.col(text).alias("value"))
        rows = t if rows is None else rows.unionAll(t)
    forms = looks.canonical(rows, "value", ["table_name", "row_key", "document", "stored"], keep_text)
    return forms.dropDuplicates(["table_name", "row_key"])


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, keep_text=False).drop("canonical").filter(F.col("digest").isNotNull() & F.col("document").isNotNull())


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_classes(_digests(spark, sf_dir), ["table_name", "document"], "row_key", "stored")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _digests(spark, sf_dir)
    return looks.same_look_pairs(forms, ["table_name", "document"], "row_key", "stored").select("table_name", "key_a", "key_b")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, keep_text=True).select("table_name", "row_key", "canonical")


def _sentences(spark: SparkSession, sf_dir: str, what: Callable) -> DataFrame:
    """The two tables of problem 4 with what(text) of each row; a re-delivered row counts once."""
    pages = table(spark, sf_dir, "page_text").filter(F.col("text_origin") == "native")
    lines = table(spark, sf_dir, "public_challenges")
    rows = pages.select(F.lit("page_text").alias("table_name"), F.col("page_id").alias("row_key"), what(F.col("text")).alias("s")).unionAll(
        lines.select(F.lit("public_challenges").alias("table_name"), F.col("case_id").alias("row_key"), what(F.col("expected_line")).alias("s"))
    )
    return rows.dropDuplicates(["table_name", "row_key"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir, sentences.starts).select("table_name", "row_key", F.explode("s").alias("start_pos"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir, sentences.sentences).select("table_name", "row_key", F.posexplode("s").alias("number", "s"))
    return rows.select("table_name", "row_key", "number", "s.start", "s.end", "s.sentence")


def _scans(spark: SparkSession, sf_dir: str, paragraphs_too: bool) -> DataFrame:
    titles = table(spark, sf_dir, "document_catalog").select(F.col("document_id").alias("document"), "title")
    return scans.read_scans(table(spark, sf_dir, "page_text"), "page_id", "document_id", "text", "status", "text_origin", titles, paragraphs_too)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, False).select("page_id", F.explode("found").alias("f")).select("page_id", "f.line_no", "f.kind")


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir, True).select("page_id", "repaired")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _limits(spark, sf_dir)["container_tokens"]
    sizes = materialize(tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "tokens", packing.default_costs([top >> 3, top >> 2, top >> 1, top]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_keys(_packed(spark, sf_dir), "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(materialize(_packed(spark, sf_dir), "packed"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, containers that hold more than they can, documents with a gap or an overlap between pieces, and pieces of what fits whole."""
    top = _limits(spark, sf_dir)["container_tokens"]
    packed = materialize(_packed(spark, sf_dir), "packed")
    over = packed.groupBy("container", "capacity").agg(F.sum("tokens").alias("t")).filter((F.col("t") > F.col("capacity")) | (F.col("capacity") > top)).agg(F.count("*").alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.count("*").alias("n"))
    sums = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("t") != F.col("end")).alias("broken"), F.count_if((F.col("n") > 1) & (F.col("t") <= top)).alias("needless"))
    return sums.crossJoin(F.broadcast(over))


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).filter("truncated").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, sf_dir))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, and those without text that were judged, which must be none."""
    found = _truncated(spark, sf_dir)
    return found.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("log_odds").isNull()).alias("without_text"), F.count_if(F.col("log_odds").isNull() & F.col("truncated")).alias("judged_without_text"))


def p8_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [n for n in globals() if n[0] == "p" and n[1:2].isdigit()]
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
