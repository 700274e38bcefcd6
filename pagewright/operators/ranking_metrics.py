"""Metrics of rankings at several budgets, and their means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGETS = (1, 2, 3, 5, 10)
METRICS = ("recall", "all_evidence", "reciprocal_rank", "average_precision", "ndcg")


def at_budgets(ranked: DataFrame, relevant: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """query_id, k and METRICS. ranked: query_id, page_number, rank; relevant: query_id, page_number, each pair once.

    Only the hits leave the join: a query has as many rows as relevant pages, not as pages.
    """
    need = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return of_hits(ranked.join(relevant, ["query_id", "page_number"]), need, budgets)


def of_hits(hits: DataFrame, need: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """The same of hits: query_id and rank of the relevant pages that are ranked, at least up to the largest budget; need: query_id and n_rel, the number of relevant pages."""
    if any(k < 1 for k in budgets):
        raise ValueError("budgets must be positive")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.select("query_id", "rank", F.count("*").over(w).alias("nth"))
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "nth"))).alias("hits"))
    rows = need.join(per, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(budgets))))))
    inside = F.filter(F.coalesce("hits", F.expr("cast(array() as array<struct<rank:int,nth:bigint>>)")), lambda h: h["rank"] <= F.col("k"))
    rows = rows.withColumn("in", inside).withColumn("m", F.least("n_rel", F.col("k").cast("bigint")))
    total = lambda f: F.aggregate("in", F.lit(0.0), lambda s, h: s + f(h))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("m")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return rows.select(
        "query_id", "k", (F.size("in") / F.col("n_rel")).alias("recall"), (F.size("in") == F.col("n_rel")).cast("double").alias("all_evidence"),
        F.coalesce(1 / F.get("in", F.lit(0))["rank"], F.lit(0.0)).alias("reciprocal_rank"),
        (total(lambda h: h["nth"] / h["rank"]) / F.col("m")).alias("average_precision"), (total(lambda h: 1 / F.log2(h["rank"] + 1)) / ideal).alias("ndcg"),
    )


def means(scored: DataFrame, *by: str) -> DataFrame:
    """Means of METRICS by k and other columns, rounded to 9 digits."""
    return scored.groupBy("k", *by).agg(*[F.round(F.avg(m), 9).alias(m) for m in METRICS], F.count("*").alias("questions"))


def document_means(scored: DataFrame, document: str) -> DataFrame:
    """Equal-document means by k: means of the documents' means."""
    each = scored.groupBy("k", document).agg(*[F.avg(m).alias(m) for m in METRICS])
    return each.groupBy("k").agg(*[F.round(F.avg(m), 9).alias(m) for m in METRICS], F.count("*").alias("documents"))


def ranking_violations(ranked: DataFrame, queries: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, expected, pages and numbers of the rankings that aren't a permutation of all pages of the query's document.

    ranked, queries and pages: query_id, document_id and page_number as in retrieval.rank. A page that the document lacks is a violation too.
    """
    sizes = pages.groupBy("document_id").agg(F.countDistinct("page_number").alias("expected"))
    known = ranked.select("query_id", "document_id", "page_number").join(pages.select("document_id", "page_number", F.lit(1).alias("_in")).distinct(), ["document_id", "page_number"], "left")
    each = known.groupBy("query_id").agg(F.count("*").alias("pages"), F.countDistinct("page_number").alias("numbers"), F.count_if(F.col("_in").isNull()).alias("_odd"))
    rows = queries.select("query_id", "document_id").join(sizes, "document_id").join(each, "query_id", "left").fillna(0, ["pages", "numbers", "_odd"])
    return rows.filter((F.col("pages") != F.col("expected")) | (F.col("numbers") != F.col("expected")) | (F.col("_odd") > 0)).select("query_id", "expected", "pages", "numbers")
