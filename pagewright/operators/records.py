"""Scores of prediction records against reference records, with diagnostics; a question is never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring as S


def coverage_errors(references: DataFrame, predictions: DataFrame, key: str = "question_id") -> DataFrame:
    """key and error: repeated_reference, repeated_prediction, missing_prediction or unknown_question; none for whole data."""
    a = references.groupBy(key).agg(F.count("*").alias("_a"))
    b = predictions.groupBy(key).agg(F.count("*").alias("_b"))
    both = a.join(b, key, "full")
    errors = F.array(
        F.when(F.col("_a") > 1, "repeated_reference"), F.when(F.col("_b") > 1, "repeated_prediction"),
        F.when(F.col("_b").isNull(), "missing_prediction"), F.when(F.col("_a").isNull(), "unknown_question"),
    )
    return both.select(key, F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


def require_coverage(references: DataFrame, predictions: DataFrame, key: str = "question_id") -> None:
    """ValueError with counts, unless each reference has one prediction and each prediction a reference."""
    found = coverage_errors(references, predictions, key).groupBy("error").count().collect()
    if found:
        raise ValueError("coverage differs: " + ", ".join(f"{r['error']}={r['count']}" for r in sorted(found)))


def _share(part: Column, whole: Column, empty: float | None) -> Column:
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(empty).cast("double"))


def score_records(references: DataFrame, predictions: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row for each reference: scores, evidence diagnostics and failure category.

    references: question_id, document_id, language, answer_format, answer, evidence_pages, and available_pages, the pages that
    were supplied. predictions: question_id, answer, evidence_pages, schema_valid, abstain, parser_error. judged: question_id and
    equivalent, decisions of a judge on texts and numbers, which then stand instead of the exact comparison. A reference
    without a prediction scores as an invalid response with no answer; require_coverage rejects such data.
    """
    own = predictions.select("question_id", F.col("answer").alias("_answer"), F.col("evidence_pages").alias("_pages"), "schema_valid", "abstain", "parser_error")
    rows = references.join(own, "question_id", "left")
    none = F.array().cast("array<int>")
    gold, cited, given = (F.array_distinct(F.coalesce(F.col(c).cast("array<int>"), none)) for c in ("evidence_pages", "_pages", "available_pages"))
    valid = F.coalesce("schema_valid", F.lit(False))
    exact = S.answer_score(F.col("answer_format"), F.coalesce("answer", F.lit("")), F.coalesce("_answer", F.lit("")))
    if judged is not None:
        rows = rows.join(judged.select("question_id", "equivalent"), "question_id", "left")
        exact = F.when(~F.col("answer_format").isin("ordered_list", "unordered_list"), F.coalesce(F.col("equivalent").cast("double"), exact)).otherwise(exact)
    rows = rows.withColumn("answer_score", F.when(F.col("_answer").isNull() & F.col("answer").isNotNull(), 0.0).otherwise(exact)).withColumn("evidence_f1", S.set_f1(gold, cited))
    rows = rows.withColumn("retrieval_recall", _share(F.array_intersect(gold, given), gold, 1.0))
    out = rows.select(
        "question_id", "document_id", "language", "answer_format", "retrieval_recall", (F.size(F.array_except(gold, given)) == 0).alias("all_evidence_retrieved"),
        _share(F.array_intersect(gold, cited), cited, 0.0).alias("evidence_precision"), _share(F.array_intersect(gold, cited), gold, 1.0).alias("evidence_recall"),
        valid.alias("schema_valid"), F.coalesce("abstain", F.lit(False)).alias("abstain"), "parser_error", F.size(given).alias("input_pages"), "answer_score", "evidence_f1",
    )
    out = out.withColumn("overall", (F.col("answer_score") + F.col("evidence_f1")) / 2)
    return out.withColumn("failure_category", S.failure_category(F.col("schema_valid"), F.col("all_evidence_retrieved").cast("double"), F.col("answer_score"), F.col("evidence_f1")))


def diagnostics(scored: DataFrame) -> DataFrame:
    """One row: rates and means of scored records; zeros where there are none."""
    rates = ("schema_valid", "abstain", "all_evidence_retrieved")
    means = ("evidence_precision", "evidence_recall", "retrieval_recall", "answer_score", "evidence_f1", "overall")
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 9)
    return scored.agg(F.count("*").alias("questions"), *[mean(c).alias(f"{c}_rate") for c in rates], *[mean(c).alias(c) for c in means])


def decide(pairs: DataFrame, known: DataFrame, judge, identity: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Decisions of a judge, each distinct pair judged once: decisions for the pairs' keys, and new rows for the store.

    pairs: key, language, reference, prediction. known: identity, language, reference, prediction, equivalent; a stored
    decision of the same identity stands. judge(language, reference, prediction) is a Column of booleans; a null decision is malformed and
    isn't stored, so it is asked again.
    """
    on = ["language", "reference", "prediction"]
    wanted = pairs.select(*on).distinct()
    mine = known.filter(F.col("identity") == identity).select(*on, "equivalent")
    # Nulls are values of a pair.
    same = lambda a, b: F.col(f"{a}.language").eqNullSafe(F.col(f"{b}.language")) & F.col(f"{a}.reference").eqNullSafe(F.col(f"{b}.reference")) & F.col(f"{a}.prediction").eqNullSafe(F.col(f"{b}.prediction"))
    missing = wanted.alias("w").join(mine.alias("m"), same("w", "m"), "left_anti")
    new = missing.withColumn("equivalent", judge(F.col("language"), F.col("reference"), F.col("prediction"))).filter(F.col("equivalent").isNotNull())
    decided = mine.unionByName(new)
    out = pairs.alias("p").join(decided.alias("d"), same("p", "d"), "left").select("p.key", "d.equivalent")
    return out, new.select(F.lit(identity).alias("identity"), *on, "equivalent")


def require_probes(probes: DataFrame, judge) -> int:  # noqa: ANN001
    """The number of probes, all of which a judge must pass before it may score: language, reference, prediction, expected."""
    bad = probes.filter(~judge(F.col("language"), F.col("reference"), F.col("prediction")).eqNullSafe(F.col("expected"))).count()
    n = probes.count()
    if bad or not n:
        raise ValueError(f"{bad} of {n} probes failed")
    return n


def compare_runs(scored: DataFrame, run: str, question: str, document: str, value: str, compatible: list[str]) -> DataFrame:
    """Each pair of runs with equal compatible columns: documents, mean delta, improved, tied and regressed documents.

    Runs are few by nature; documents of a pair are joined by name. A document that one run lacks gives a pair the count in `missing`.
    """
    means = scored.groupBy(run, *compatible, document).agg(F.avg(value).alias("v"))
    names = scored.select(run, *compatible).distinct()
    a, b = names.withColumnRenamed(run, "left_run"), names.withColumnRenamed(run, "right_run")
    both = F.col("left_run") < F.col("right_run")
    for c in compatible:
        a, b = a.withColumnRenamed(c, f"_a_{c}"), b.withColumnRenamed(c, f"_b_{c}")
        both = both & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    pairs = a.join(F.broadcast(b), both).select("left_run", "right_run")
    side = lambda s: pairs.join(means.select(F.col(run).alias(f"{s}_run"), document, F.col("v").alias(s)), f"{s}_run")
    j = side("left").join(side("right"), ["left_run", "right_run", document], "full").withColumn("delta", F.round(F.col("right") - F.col("left"), 12))
    d = F.col("delta")
    return j.groupBy("left_run", "right_run").agg(
        F.count("*").alias("documents"), F.count_if(d.isNull()).alias("missing"), F.round(F.avg(d), 9).alias("mean_delta"),
        F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("tied"), F.count_if(d < 0).alias("regressed"),
    )


def metric_identities(scored: DataFrame, answer: str, evidence: str, overall: str, document: str, tolerance: float = 1e-12) -> DataFrame:
    """identity and violations: scores in range, overall the mean of both, and the question mean equal to documents' means by their weights."""
    inside = lambda c: F.col(c).between(0, 1)
    rows = scored.agg(
        F.count_if(~F.coalesce(inside(answer) & inside(evidence) & inside(overall), F.lit(False))).alias("range"),
        F.count_if(~F.coalesce(F.abs(F.col(overall) - (F.col(answer) + F.col(evidence)) / 2) <= tolerance, F.lit(False))).alias("formula"),
        F.avg(overall).alias("mean"), F.count(overall).alias("n"),
    )
    weighted = scored.groupBy(document).agg(F.avg(overall).alias("m"), F.count(overall).alias("k")).agg(F.sum(F.col("m") * F.col("k")).alias("w"))
    whole = rows.crossJoin(F.broadcast(weighted)).withColumn("weights", (F.abs(F.col("w") / F.col("n") - F.col("mean")) > 1e-9).cast("bigint"))
    return whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("identity"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations")) for c in ("range", "formula", "weights")])).alias("i")).select("i.*")


def first_complete(attempts: DataFrame, question: str, order: str, complete: Column) -> DataFrame:
    """Of each question, the attempt that is complete and first in order, whole; a question without one keeps its last attempt, unresolved.

    question, resolved, attempts and the columns of the attempt.
    """
    rest = [c for c in attempts.columns if c != question]
    rows = attempts.withColumn("_ok", F.coalesce(complete, F.lit(False)))
    best = F.coalesce(F.min_by(F.when(F.col("_ok"), F.struct(*rest)), F.when(F.col("_ok"), F.col(order))), F.max_by(F.struct(*rest), order))
    out = rows.groupBy(question).agg(best.alias("_r"), F.bool_or("_ok").alias("resolved"), F.count("*").alias("attempts"))
    return out.select(question, "resolved", "attempts", "_r.*")


def search_rounds(questions: DataFrame, candidates: DataFrame, answer, complete, rounds: int) -> DataFrame:  # noqa: ANN001
    """first_complete with readings made as needed: in each round the unresolved questions' next candidates are read, and no others.

    questions: question_id and more. candidates: question_id, attempt (from 1), pages. answer(rows) reads rows of both; complete is
    a Column over its result. At most `rounds` rounds; the rest stays unresolved, with all its attempts counted.
    """
    from ..session import materialize

    done, todo = None, questions
    for n in range(1, rounds + 1):
        rows = todo.join(candidates.filter(F.col("attempt") == n), "question_id")
        read = materialize(answer(rows), "attempts")
        if read.isEmpty():
            break
        done = read if done is None else done.unionByName(read)
        todo = materialize(todo.join(read.filter(F.coalesce(complete, F.lit(False))).select("question_id"), "question_id", "left_anti"), "todo")
        if todo.isEmpty():
            break
    if done is None:
        raise ValueError("no candidates were given")
    return first_complete(done, "question_id", "attempt", complete)
