"""Profiles, audits, folds, keys and constraint checks over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import materialize


def once(df: DataFrame, *key: str) -> DataFrame:
    """Re-delivered rows count once."""
    return df.dropDuplicates(list(key))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, rows, missing, nonmissing, distinct_values and max_length, values as stripped strings; null-like ones are missing."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), X.strip(F.col(c).cast("string")).alias("v")) for c in columns])).alias("c")).select("c.*")
    missing = X.is_nullish(F.col("v"))
    # Values are counted once each before they are counted as distinct, so a long column isn't one task's.
    each = cells.withColumn("v", F.when(~missing, F.col("v"))).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return each.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("nonmissing"),
        F.count("v").alias("distinct_values"), F.coalesce(F.max(F.length("v")), F.lit(0)).alias("max_length"),
    )


def numeric_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, quartiles, max and mean of a column, nulls left out."""
    v = F.col(value).cast("double")
    aggs = [F.count(v).alias("n"), F.min(v).alias("minimum"), *[F.round(F.percentile(v, F.lit(p)), 6).alias(a) for a, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max(v).alias("maximum"), F.round(F.avg(v), 6).alias("mean")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def duplicate_groups(df: DataFrame, content: str, group: str) -> DataFrame:
    """digest, copies and groups of each content that occurs more than once. A null content is none."""
    d = df.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), group)
    each = d.groupBy("digest", group).agg(F.count("*").alias("n"))
    return each.groupBy("digest").agg(F.sum("n").alias("copies"), F.count(F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("groups")).filter("copies > 1")


def content_class(chars: Column) -> Column:
    """native_text, scan_like or mixed by the share of pages with text."""
    return F.when(chars >= 0.9, "native_text").when(chars <= 0.1, "scan_like").otherwise("mixed")


def document_coverage(pages: DataFrame) -> DataFrame:
    """Pages, textless, errors, characters and the content class of each document. pages: document_id, status, text."""
    status = F.lower(X.strip(F.coalesce("status", F.lit(""))))
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    out = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(status == "textless").alias("textless"), F.count_if(status == "extraction_error").alias("errors"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.avg((chars >= 20).cast("double")).alias("_share"),
    )
    return out.select("document_id", "pages", "textless", "errors", "chars", F.round("_share", 6).alias("text_share"), content_class(F.col("_share")).alias("content_class"))


def page_sequence_violations(pages: DataFrame, document: str, number: str) -> DataFrame:
    """Documents whose page numbers aren't exactly 1 to N."""
    g = pages.groupBy(document).agg(F.min(number).alias("first_page"), F.max(number).alias("last_page"), F.count("*").alias("pages"), F.countDistinct(number).alias("numbers"))
    return g.filter((F.col("first_page") != 1) | (F.col("last_page") != F.col("numbers")) | (F.col("pages") != F.col("numbers")))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks, and those of right that left lacks, with the side that lacks them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))


def aliases(df: DataFrame, key: str, prefix: str, width: int = 2) -> DataFrame:
    """key and a dense alias by the key's order. Ranks come from range partitions, so no task sorts all keys."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    # Stored, as ranges come from a sample and would part keys otherwise when they are made again.
    placed = materialize(keys.repartitionByRange(parts, key).select(key, F.spark_partition_id().alias("p")), "placed")
    within = placed.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(key)))
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    rank = F.col("r") + F.coalesce("before", F.lit(0))
    return within.join(F.broadcast(before), "p").select(key, F.format_string(f"{prefix}%0{width}d", rank).alias("alias"))


def leave_one_out(questions: DataFrame, document: str, question: str) -> DataFrame:
    """fold, document, validation and training sizes: a fold for each document, whose questions are held out.

    Rows of training aren't listed: they are all questions of the other documents, which fold_roles gives on demand.
    """
    n = questions.groupBy(document).agg(F.countDistinct(question).alias("validation"))
    total = n.agg(F.sum("validation").alias("_t"))
    named = n.join(aliases(questions, document, "outer-"), document)
    return named.crossJoin(F.broadcast(total)).select(F.col("alias").alias("fold"), document, "validation", (F.col("_t") - F.col("validation")).alias("training"))


def fold_roles(questions: DataFrame, document: str, question: str, folds: DataFrame) -> DataFrame:
    """fold, question and role for the folds given: a stated set of folds, which is sent to all tasks, against all questions."""
    stated = F.broadcast(folds.agg(F.collect_list(F.struct("fold", F.col(document).alias("held"))).alias("_folds")))
    each = questions.select(document, question).distinct().crossJoin(stated).select(document, question, F.explode("_folds").alias("f"))
    return each.select("f.fold", question, F.when(F.col(document) == F.col("f.held"), "validation").otherwise("train").alias("role"))


def nested_folds(questions: DataFrame, document: str, question: str) -> DataFrame:
    """outer_document, inner folds and questions: within each outer fold's training documents, a fold for each of them.

    One row for each outer fold, by arithmetic, as a row for each pair would be quadratic: the number of inner folds, the
    questions that they validate in turn, and the least and the most that one of them trains on. nested_pairs lists stated ones.
    """
    n = questions.groupBy(document).agg(F.countDistinct(question).alias("n")).join(aliases(questions, document, "d"), document)
    # The two largest and the two smallest documents tell what is left without an outer one.
    total = n.agg(F.sum("n").alias("_t"), F.count("*").alias("_d"), F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    ends = n.groupBy("n").agg(F.count("*").alias("c"))
    second = ends.crossJoin(F.broadcast(total)).agg(F.max(F.when((F.col("n") < F.col("_hi")), F.col("n"))).alias("_hi2"), F.min(F.when(F.col("n") > F.col("_lo"), F.col("n"))).alias("_lo2"), F.max(F.when(F.col("n") == F.col("_hi"), F.col("c"))).alias("_hic"), F.max(F.when(F.col("n") == F.col("_lo"), F.col("c"))).alias("_loc"))
    rows = n.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(second))
    most = F.when((F.col("n") == F.col("_hi")) & (F.col("_hic") == 1), F.col("_hi2")).otherwise(F.col("_hi"))
    least = F.when((F.col("n") == F.col("_lo")) & (F.col("_loc") == 1), F.col("_lo2")).otherwise(F.col("_lo"))
    left = F.col("_t") - F.col("n")
    return rows.filter("_d >= 3").select(F.col("alias").alias("outer_document"), (F.col("_d") - 1).alias("inner_folds"), left.alias("validated"), (left - most).alias("least_training"), (left - least).alias("most_training"))


def nested_pairs(questions: DataFrame, document: str, question: str, outer: Sequence[str]) -> DataFrame:
    """outer_document, inner_document, validation and training sizes for stated outer documents."""
    n = questions.filter(F.col(document).isNotNull()).groupBy(document).agg(F.countDistinct(question).alias("validation"))
    total = n.agg(F.sum("validation").alias("_t"))
    held = F.broadcast(n.filter(F.col(document).isin(*outer)).select(F.col(document).alias("outer_document"), F.col("validation").alias("_o")))
    pairs = n.join(held, F.col(document) != F.col("outer_document")).crossJoin(F.broadcast(total))
    return pairs.select("outer_document", F.col(document).alias("inner_document"), "validation", (F.col("_t") - F.col("_o") - F.col("validation")).alias("training"))


def fold_violations(roles: DataFrame, questions: DataFrame, document: str, question: str) -> DataFrame:
    """violation and rows: what is wrong with folds that claim to hold out each document once. None for those of fold_roles with all folds.

    roles: fold, question, role. Kinds: unknown_question, both_roles, incomplete_fold (it lacks a question), shared_document (a
    document is in both roles of a fold) and not_held_out_once (a question isn't validated in exactly one fold).
    """
    own = questions.select(document, question).distinct()
    known = roles.join(own, question, "left")
    kinds = [
        known.filter(F.col(document).isNull()).groupBy().agg(F.count("*").alias("rows")).select(F.lit("unknown_question").alias("violation"), "rows"),
        roles.groupBy("fold", question).agg(F.countDistinct("role").alias("n")).filter("n > 1").agg(F.count("*").alias("rows")).select(F.lit("both_roles").alias("violation"), "rows"),
        roles.groupBy("fold").agg(F.countDistinct(question).alias("n")).crossJoin(F.broadcast(own.agg(F.countDistinct(question).alias("all")))).filter("n <> all").agg(F.count("*").alias("rows")).select(F.lit("incomplete_fold").alias("violation"), "rows"),
        known.groupBy("fold", document).agg(F.countDistinct("role").alias("n")).filter("n > 1").agg(F.count("*").alias("rows")).select(F.lit("shared_document").alias("violation"), "rows"),
        own.select(question).distinct().join(roles.filter("role = 'validation'").groupBy(question).agg(F.countDistinct("fold").alias("n")), question, "left").filter("coalesce(n, 0) <> 1").agg(F.count("*").alias("rows")).select(F.lit("not_held_out_once").alias("violation"), "rows"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.filter("rows > 0")


def fold_facts(questions: DataFrame, document: str, question: str, facts: Sequence[str]) -> DataFrame:
    """document, fact, value and questions of the fold that holds the document out: counts without any text."""
    each = questions.filter(F.col(document).isNotNull()).select(document, question, F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])).alias("f"))
    return each.groupBy(document, "f.fact", "f.value").agg(F.countDistinct(question).alias("questions"))


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and every check that a row fails; checks hold where true, and null counts as failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(failed).alias("violation"))


def unequal(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than a relative tolerance, zero only equal to zero, or that one side lacks."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    same = F.when((F.col("_a") == 0) | (F.col("_b") == 0), F.col("_a") == F.col("_b")).otherwise(F.abs(F.col("_a") - F.col("_b")) <= tolerance * (1 + F.abs(F.col("_b"))))
    return j.filter(~F.coalesce(same, F.lit(False))).select(key, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"))


def fitting(needs: DataFrame, catalog: DataFrame, limits: Sequence[str]) -> DataFrame:
    """Rows of needs with the entries of a catalog that have at least as much of every limit. The catalog is a price list, sent to all tasks."""
    c = catalog
    for x in limits:
        c = c.withColumnRenamed(x, f"_has_{x}")
    ok = F.lit(True)
    for x in limits:
        ok = ok & (F.col(f"_has_{x}") >= F.col(x))
    return needs.join(F.broadcast(c), ok)


def cost_estimates(jobs: DataFrame, rate: str, seconds: str, count: str, contingency: float = 1.25, cap: float | None = None) -> DataFrame:
    """jobs with maximum_cost, to 4 digits, half to even, and cost_error: bad_rate, bad_seconds, bad_count or over_cap; a wrong row has no cost."""
    good = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    finite = F.coalesce(F.abs(F.col(rate)) < float("inf"), F.lit(False))
    cost = F.bround(F.col(rate) * (F.col(seconds) / 3600.0) * F.col(count) * contingency, 4)
    error = F.when(~(good(rate) & finite), "bad_rate").when(~good(seconds), "bad_seconds").when(~good(count), "bad_count")
    out = jobs.withColumn("maximum_cost", F.when(error.isNull(), cost))
    return out.withColumn("cost_error", error if cap is None else F.coalesce(error, F.when(F.col("maximum_cost") > cap, "over_cap")))


def single_match(wanted: DataFrame, offered: DataFrame, key: str, name: str) -> DataFrame:
    """key, matches and the offer of each wanted name that has exactly one offer of the same letters and digits; others have a null offer."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    o = offered.select(plain(F.col(name)).alias("_k"), F.struct(*offered.columns).alias("offer"))
    j = wanted.select(key, plain(F.col(name)).alias("_k")).join(o, "_k", "left").groupBy(key).agg(F.count("offer").alias("matches"), F.first("offer", True).alias("offer"))
    return j.withColumn("offer", F.when(F.col("matches") == 1, F.col("offer")))
