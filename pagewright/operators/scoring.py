"""Answer and evidence scores, failure categories, aggregates of them and paired statistics."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import rows_shuffled


def set_f1(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of sets; 1 if both are empty, 0 if one is."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(sizes, F.lit(1)))


def exactly_equal(a: Column, b: Column) -> Column:
    """Equal as normalized texts, or as numbers; this relation isn't transitive."""
    return (X.normalize_text(a) == X.normalize_text(b)) | F.coalesce(X.decimal_key(a) == X.decimal_key(b), F.lit(False))


def multiset_f1(a: Column, b: Column) -> Column:
    """The unordered list score where equality is an equivalence: 2 matched / (m + n)."""
    matched = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * matched / F.greatest(total, F.lit(1)))


def maximum_matching(edges: Sequence[Sequence[bool]]) -> int:
    """The size of a maximum matching of a boolean matrix, by augmenting paths."""
    if len({len(r) for r in edges}) > 1:
        raise ValueError("rows must have one length")
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j, ok in enumerate(edges[i]):
            if ok and j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(edges)))


def longest_common(edges: Sequence[Sequence[bool]]) -> int:
    """The length of the longest common subsequence under a match matrix."""
    width = len(edges[0]) if edges else 0
    row = [0] * (width + 1)
    for r in edges:
        before = row[:]
        for j in range(width):
            row[j + 1] = before[j] + 1 if r[j] else max(row[j], before[j + 1])
    return row[width]


def answer_score(fmt: Column, reference: Column, prediction: Column) -> Column:
    """The score of an answer by its format; list items count as equal as in exactly_equal. Null answers are empty."""

    @F.pandas_udf("double")
    def lists(fmts, ref, pred, ref_num, pred_num):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(f: str, a: list, b: list, an: list, bn: list) -> float:
            a, b, an, bn = list(a), list(b), list(an), list(bn)
            if not len(a) and not len(b):
                return 1.0
            if not len(a) or not len(b):
                return 0.0
            m = [[x == y or (xn is not None and xn == yn) for y, yn in zip(b, bn)] for x, xn in zip(a, an)]
            return longest_common(m) / max(len(a), len(b)) if f == "ordered_list" else 2 * maximum_matching(m) / (len(a) + len(b))

        return pd.Series([one(*r) for r in zip(fmts, ref, pred, ref_num, pred_num)])

    r, p = F.coalesce(reference, F.lit("")), F.coalesce(prediction, F.lit(""))
    keys = lambda c: _each(X.list_answer(c))
    a, b = keys(r), keys(p)
    by_list = lists(fmt, a["text"], b["text"], a["number"], b["number"])
    return F.when(fmt.isin("ordered_list", "unordered_list"), by_list).otherwise(exactly_equal(r, p).cast("double"))


def _each(items: Column) -> Column:
    """Normalized texts and number keys of a list's items."""

    @F.pandas_udf("struct<text:array<string>,number:array<string>>")
    def run(s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame({"text": [[X.comparable(t) for t in x] for x in s], "number": [[X.number_key(t) for t in x] for x in s]})

    return run(items)


def failure_category(schema_valid: Column, recall: Column, answer: Column, evidence: Column) -> Column:
    """The first of: invalid_response, missing_evidence, answer_incomplete_or_incorrect, evidence_citation_incomplete, full_credit."""
    return F.when(~schema_valid, "invalid_response").when(recall < 1, "missing_evidence").when(answer < 1, "answer_incomplete_or_incorrect").when(evidence < 1, "evidence_citation_incomplete").otherwise("full_credit")


def score_summary(scored: DataFrame, values: Sequence[str], document: str, dimensions: Sequence[str]) -> DataFrame:
    """dimension, value, questions and means: over all questions, for each value of a dimension, and the mean of documents.

    One pass with grouping sets; the dimension is told by grouping_id, as a null value is a value.
    """
    dims = [document, *[d for d in dimensions if d != document]]
    sets = [[], *[[d] for d in dims]]
    n = len(dims)
    g = scored.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().alias("_g"), F.count("*").alias("questions"), *[F.avg(v).alias(v) for v in values])
    names = F.create_map(F.lit((1 << n) - 1), F.lit("all"), *[x for i, d in enumerate(dims) for x in (F.lit((1 << n) - 1 - (1 << (n - 1 - i))), F.lit(d))])
    value = F.coalesce(*[F.col(d).cast("string") for d in dims])
    sliced = g.select(F.element_at(names, F.col("_g").cast("int")).alias("dimension"), value.alias("value"), "questions", *values)
    macro = sliced.filter(F.col("dimension") == document).agg(F.sum("questions").alias("questions"), *[F.avg(v).alias(v) for v in values])
    macro = macro.select(F.lit("document_macro").alias("dimension"), F.lit(None).cast("string").alias("value"), "questions", *values)
    return sliced.unionByName(macro).select("dimension", "value", "questions", *[F.round(v, 9).alias(v) for v in values])


def gap_profile(scored: DataFrame, fmt: str, answer: str, grounding: str) -> DataFrame:
    """Each format's part of the lost score: (1 - mean) n / 2N for answers and for grounding."""
    g = scored.groupBy(fmt).agg(F.count("*").alias("questions"), F.sum(1 - F.col(answer)).alias("a"), F.sum(1 - F.col(grounding)).alias("g"))
    total = scored.agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select(fmt, "questions", F.round(F.col("a") / (2 * F.col("n")), 9).alias("answer_gap"), F.round(F.col("g") / (2 * F.col("n")), 9).alias("grounding_gap"))


def paired(champion: DataFrame, challenger: DataFrame, document: str, value: str) -> DataFrame:
    """document and delta; documents that one side lacks have a null delta and are for the caller to reject."""
    a, b = champion.select(document, F.col(value).alias("_a")), challenger.select(document, F.col(value).alias("_b"))
    return a.join(b, document, "full").select(document, (F.col("_b") - F.col("_a")).alias("delta"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    """Documents, mean, median, minimum and maximum delta, and how many improved, tied or regressed."""
    d = F.col("delta")
    return deltas.agg(
        F.count("*").alias("documents"), F.round(F.avg(d), 9).alias("mean_delta"), F.round(F.percentile(d, F.lit(0.5)), 9).alias("median_delta"), F.round(F.min(d), 9).alias("minimum_delta"), F.round(F.max(d), 9).alias("maximum_delta"),
        F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("tied"), F.count_if(d < 0).alias("regressed"),
    )


def sign_flip(deltas: DataFrame, most: int = 20) -> DataFrame:
    """The exact two-sided sign-flip p-value; 2^n outcomes are made in parallel, so at most `most` documents are permitted."""
    rows = deltas.agg(F.array_sort(F.collect_list("delta")).alias("d")).withColumn("n", F.size("d"))
    rows = rows.withColumn("_ok", F.when((F.col("n") < 1) | (F.col("n") > most), F.raise_error(F.lit("too few or too many documents for exact enumeration"))).otherwise(F.lit(1)))
    flips = rows.filter("_ok = 1").withColumn("bits", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, n) - 1"))))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda s, i: s + F.when(F.expr("1=1") & (F.getbit(F.col("bits"), i) == 1), -F.get("d", i)).otherwise(F.get("d", i)))
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x)) / F.col("n")
    return flips.agg(F.round(F.avg((F.abs(total) / F.col("n") >= observed - 1e-15).cast("double")), 9).alias("p_value"), F.first("n").alias("documents"))


#: Draws of a lot, about.
DRAWS = 2_000_000


class Draws:
    """What random.Random in a state gives for randrange(n), n numbers at a time."""

    def __init__(self, state: tuple, n: int):
        self.n, self.bits = n, n.bit_length()
        if self.bits > 32:
            raise ValueError("at most 2^32 - 1 documents")
        words, self.left = state[1], state[3] if len(state) > 3 else np.zeros(0, np.int64)
        self.generator = np.random.MT19937()
        self.generator.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint32), "pos": int(words[-1])}}

    def state(self) -> tuple:
        """A state to go on from; like random.getstate(), and the numbers drawn but not taken yet."""
        s = self.generator.state["state"]
        return (3, (*s["key"].tolist(), s["pos"]), None, self.left)

    def take(self) -> np.ndarray:
        """The next n numbers: the uppermost bits of words of 32, those too large left out."""
        while len(self.left) < self.n:
            words = self.generator.random_raw(max(64, (self.n - len(self.left)) * 5 // 4)) >> np.uint64(32 - self.bits)
            self.left = np.concatenate([self.left, words[words < self.n].astype(np.int64)])
        out, self.left = self.left[: self.n], self.left[self.n :]
        return out


def bootstrap_interval(deltas: DataFrame, document: str, seed: int, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """The percentile interval of document means, with the generator random.Random(seed).randrange.

    The draws are one sequence by nature: a first pass over it, made in one task, notes the generator's state where each
    lot of draws begins; the lots are drawn again from there in parallel. The documents' deltas, sent to all tasks, and
    the means are all that the driver holds. Documents go by name.
    """
    if resamples < 1 or not 0 < confidence < 1:
        raise ValueError("resamples must be positive and confidence within 0 and 1")
    values = deltas.orderBy(document).select("delta").toPandas()["delta"].to_numpy(np.float64)
    if not len(values):
        raise ValueError("at least one document is needed")
    if np.isnan(values).any():
        raise ValueError("every document needs a delta")
    spark = deltas.sparkSession
    sent = spark.sparkContext.broadcast(values)
    lot = max(1, DRAWS // len(values))
    lots = -(-resamples // lot)

    def states(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = Draws(random.Random(seed).getstate(), len(sent.value))
        for k in range(lots):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(drawn.state())], pa.binary())], names=["lot", "state"])
            for _ in range(min(lot, resamples - k * lot)):
                drawn.take()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, state in zip(*(c.to_pylist() for c in batch.columns)):
                drawn = Draws(pickle.loads(state), len(sent.value))
                means = [float(sent.value[drawn.take()].sum()) / len(sent.value) for _ in range(min(lot, resamples - k * lot))]
                yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], names=["m"])

    begins = spark.range(1, numPartitions=1).mapInArrow(states, "lot int, state binary")
    means = begins.repartition(min(lots, rows_shuffled(deltas)), "lot").mapInArrow(draw, "m double").agg(F.array_sort(F.collect_list("m")).alias("m"))
    tail = (1 - confidence) / 2
    at = lambda p: F.get("m", F.lit(min(int(p * resamples), resamples - 1)))
    return means.select(at(tail).alias("lower"), at(1 - tail).alias("upper"))
