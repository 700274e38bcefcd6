"""Label-blind BM25 over the pages of one document, top k, extractive answers and page windows.

Pages: document_id, page_number, text (null or empty for a page without text). Queries: query_id, document_id, question.
Every page counts in N and in the mean length, pages without text too, and has a score, 0 at least.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import materialize

#: Characters and pages of one document that one task scores, at the mean; queries of a document that it scores at least.
BLOCK_CHARS, BLOCK_PAGES, BLOCK_QUERIES = 8_000_000, 100_000, 2_000
#: Characters that one task's small documents have, at the mean; pairs of page and query of one task where all pages are listed.
TASK_CHARS, PAIRS = 4_000_000, 5_000_000
#: Characters of a question at most.
LONGEST_QUESTION = 500
#: Statuses of pages that have no text.
NO_TEXT = ("textless", "extraction_error")


#: Arrow's types by Spark's names.
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def check_parameters(k1: float, b: float) -> None:
    if not (math.isfinite(k1) and k1 > 0 and math.isfinite(b) and 0 <= b <= 1):
        raise ValueError("k1 must be positive and b within 0 and 1")


def _folding(fold: str) -> Callable[[str], str]:
    from unicodedata import normalize

    return {"nfkc_casefold": lambda t: normalize("NFKC", t).casefold(), "lower": str.lower}[fold]


def _tokens_of(fold: str) -> Callable[[str], list[str]]:
    """functions.text.tokens for a Python worker, where tokens are counted before any row is made of them.

    Words begin with "w:"; pairs and triples of characters stand without a mark, as none holds a colon.
    """
    import regex

    segments, f = regex.compile(r"[\p{L}\p{N}]+").findall, _folding(fold)

    def tokens(text: str) -> list[str]:
        out: list[str] = []
        for s in segments(f(text)):
            out.append("w:" + s)
            if len(s) > 1:
                pairs = list(map(add, s, s[1:]))
                out += pairs
                out += map(add, pairs, s[2:])
        return out

    return tokens


def query_terms(queries: DataFrame, fold: str) -> DataFrame:
    """query_id, document_id and term, each distinct token once."""

    @F.pandas_udf("array<string>")
    def terms(s):  # noqa: ANN001, ANN202
        tokens = _tokens_of(fold)
        return s.map(lambda t: list(dict.fromkeys(tokens(t or ""))))

    return queries.select("query_id", "document_id", F.explode(terms(F.col("question"))).alias("term"))


def _blocks(pages: DataFrame, queries: DataFrame, pairs: int | None) -> tuple[DataFrame, int, int]:
    """Documents that one task doesn't hold: document_id, into how many blocks their pages and queries go; the most blocks of pages; and the number of tasks for the others."""
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    sizes = materialize(sizes.join(queries.groupBy("document_id").agg(F.count("*").alias("asked")), "document_id"), "sizes")
    blocks = F.greatest(F.ceil(F.col("chars") / BLOCK_CHARS), F.ceil(F.col("n") / BLOCK_PAGES), F.lit(1))
    # The more text a block has, the more queries are worth reading it for.
    own = F.greatest(F.lit(BLOCK_QUERIES), F.col("chars") / F.col("_pages") / (BLOCK_CHARS / 25_000))
    if pairs:
        own = F.least(own, F.greatest(F.lit(1.0), pairs * F.col("_pages") / F.col("n")))
    large = sizes.withColumn("_pages", blocks).withColumn("_queries", F.greatest(F.ceil(F.col("asked") / own), F.lit(1)))
    large = materialize(large.filter("_pages > 1 or _queries > 1").select("document_id", "_pages", "_queries"), "large")
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum("asked").alias("asked"), *([F.sum(F.col("n") * F.col("asked")).alias("pairs")] if pairs else [])).first()
    tasks = max(math.ceil((total["chars"] or 0) / TASK_CHARS), math.ceil((total["asked"] or 0) / BLOCK_QUERIES / 2), math.ceil((total["pairs"] or 0) / pairs) if pairs else 0, 1)
    return large, large.agg(F.max("_pages")).first()[0] or 0, tasks


def _once(key: str | None) -> Callable[[pa.Table], pa.Table]:
    """Of rows with the same key one, which are in one task."""

    def run(t: pa.Table) -> pa.Table:
        if not key:
            return t
        seen: dict[object, int] = {}
        for i, x in enumerate(t.column(key).to_pylist()):
            seen.setdefault(x, i)
        return t if len(seen) == t.num_rows else t.take(pa.array(list(seen.values()), pa.int64()))

    return run


def _statistics(pages: DataFrame, queries: DataFrame, fold: str, key: str | None) -> DataFrame:
    """document_id, term, n and size of documents of several blocks: pages with each term asked for; where term is null, all pages and their mean length.

    pages: with _p, the block. A block's pages are counted in one pass, so a term is a row for each block and not for each page.
    """
    kind = pages.schema["document_id"].dataType.simpleString()
    first, arrow = _once(key), ARROW[kind]

    def count(t: pa.Table) -> pa.Table:
        tokens, t = _tokens_of(fold), first(t)
        df: Counter[str | None] = Counter()
        size = 0
        for text in t.column("text").to_pylist():
            own = tokens(text or "")
            size += len(own)
            df.update(set(own))
        terms = [*df, None]
        document = t.column("document_id")[0].as_py()
        return pa.table({"document_id": pa.array([document] * len(terms), arrow), "term": pa.array(terms, pa.string()), "n": pa.array([*df.values(), t.num_rows], pa.int64()), "size": pa.array([0] * len(df) + [size], pa.int64())})

    counted = pages.groupBy("document_id", "_p").applyInArrow(count, f"document_id {kind}, term string, n bigint, size bigint")
    sums = materialize(counted.groupBy("document_id", "term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "df")
    asked = query_terms(queries, fold).select("document_id", "term").distinct()
    rows = sums.join(asked, ["document_id", "term"], "left_semi").unionByName(sums.filter("term is null"))
    return materialize(rows.select("document_id", "term", "n", (F.col("size") / F.col("n")).alias("size")), "statistics")


def _scored(pages: DataFrame, queries: DataFrame, emit: Callable, schema: str, k1: float, b: float, fold: str, key: str | None, pairs: int | None = None) -> DataFrame:
    """The rows that emit gives for each query and block of its document's pages, as schema says.

    emit(query, document, question, numbers, texts, total, whole): the pages' numbers, ascending, their texts and scores, and
    whether these are all pages of the document. Scores are rounded to 9 digits. Pages of a document and its queries meet in
    one task and are cut into tokens there, so neither a term nor a hit is a row; small documents share tasks, and of large
    ones pages and queries are cut into blocks of a bounded size, with counts of terms made beforehand. key: a column of
    pages by which re-delivered ones are told, if there may be some.
    """
    check_parameters(k1, b)
    pages = pages.select("document_id", "page_number", "text", *([key] if key else [])).filter(F.col("document_id").isNotNull())
    # Columns of their own, as both may come of one table.
    queries = queries.select(*[F.col(c).alias(c) for c in ("query_id", "document_id", "question")]).filter(F.col("document_id").isNotNull())
    large, most, tasks = _blocks(pages, queries, pairs)
    placed = pages.join(F.broadcast(large), "document_id", "left")
    single = F.col("_pages").isNull()
    cell = lambda p, q: [F.when(single, F.pmod(F.xxhash64("document_id"), F.lit(tasks))).otherwise(F.lit(-1)).cast("bigint").alias("_c"), F.when(single, "").otherwise(F.col("document_id").cast("string")).alias("_d"), p.alias("_p"), q.alias("_q")]
    own = lambda c, n: F.when(single, F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.col(n))).cast("bigint")
    every = lambda n: F.explode(F.when(single, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)))
    left = placed.select(*cell(own("page_number", "_pages"), every("_queries")), *pages.columns)
    none = lambda kind: F.lit(None).cast(kind)
    asked = queries.join(F.broadcast(large), "document_id", "left").withColumn("_own", own("query_id", "_queries"))
    right = asked.withColumn("_p", every("_pages")).select(*cell(F.col("_p"), F.col("_own")), "document_id", "query_id", "question", F.lit(False).alias("counts"), none("string").alias("term"), none("bigint").alias("n"), none("double").alias("size"))
    if most > 1:
        several = large.filter("_pages > 1")
        stats = _statistics(placed.filter("_pages > 1").withColumn("_p", own("page_number", "_pages")), queries.join(F.broadcast(several), "document_id", "left_semi"), fold, key)
        spread = stats.join(F.broadcast(several), "document_id").withColumn("_p", every("_pages")).withColumn("_q", every("_queries"))
        right = right.unionByName(spread.select(*cell(F.col("_p"), F.col("_q")), "document_id", none(queries.schema["query_id"].dataType).alias("query_id"), none("string").alias("question"), F.lit(True).alias("counts"), "term", "n", "size"))
    first, fields = _once(key), [x.rsplit(" ", 1) for x in schema.split(", ")]

    def score(held: pa.Table, wanted: pa.Table) -> pa.Table:
        tokens, held, out = _tokens_of(fold), first(held), []
        asks: dict[object, list[tuple]] = {}
        given: dict[object, dict[str | None, tuple]] = {}
        for document, query, question, counts, term, n, size in zip(*(wanted.column(c).to_pylist() for c in ("document_id", "query_id", "question", "counts", "term", "n", "size"))):
            if counts:
                given.setdefault(document, {})[term] = (n, size)
            else:
                asks.setdefault(document, []).append((query, question))
        own: dict[object, list[tuple]] = {}
        for document, number, text in zip(*(held.column(c).to_pylist() for c in ("document_id", "page_number", "text"))):
            if document in asks:
                own.setdefault(document, []).append((number, text))
        for document, rows in own.items():
            rows.sort(key=lambda r: r[0])
            numbers, texts = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
            ids: dict[str, int] = {}
            terms = [np.array([ids.setdefault(t, len(ids)) for t in dict.fromkeys(tokens(question or ""))], np.int64) for _, question in asks[document]]
            lengths, sizes, term, tf = np.zeros(len(rows)), np.zeros(len(rows), np.int64), [], []
            for i, text in enumerate(texts):
                if text:
                    cut = tokens(text)
                    lengths[i], before = len(cut), len(term)
                    found = Counter(filter(ids.__contains__, cut))
                    term += map(ids.__getitem__, found)
                    tf += found.values()
                    sizes[i] = len(term) - before
            term, tf, place = np.array(term, np.int64), np.array(tf, float), np.repeat(np.arange(len(rows)), sizes)
            df, pages_of, mean = np.bincount(term, minlength=len(ids)), len(rows), lengths.mean()
            if whole := document not in given:
                df = df.astype(float)
            else:
                pages_of, mean = given[document][None]
                df = np.zeros(len(ids))
                for t, (n, _) in given[document].items():
                    if t in ids:
                        df[ids[t]] = n
            weight = np.log1p((pages_of - df + 0.5) / (df + 0.5))
            part = weight[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[place] / (mean or 1))))
            order = np.argsort(term, kind="stable")
            place, part = place[order], part[order]
            ends = np.cumsum(np.bincount(term, minlength=len(ids))).tolist()
            dense = None
            if len(ids) * len(rows) <= 1 << 21:
                dense = np.zeros((len(ids), len(rows)))
                dense[term[order], place] = part
            for (query, question), wanted_terms in zip(asks[document], terms):
                if dense is not None:
                    total = dense[wanted_terms].sum(axis=0)
                else:
                    total = np.zeros(len(rows))
                    for t in wanted_terms.tolist():
                        x, y = ends[t - 1] if t else 0, ends[t]
                        total[place[x:y]] += part[x:y]  # a page has a term once
                out += emit(query, document, question, numbers, texts, np.round(total, 9), whole)
        columns = list(zip(*out)) if out else [[]] * len(fields)
        return pa.table({n: pa.array(c, ARROW[kind]) for (n, kind), c in zip(fields, columns)})

    names = ["_c", "_d", "_p", "_q"]
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(score, schema)


def _named(pages: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, document_id {queries.schema['document_id'].dataType.simpleString()}"


def _number(pages: DataFrame) -> str:
    return pages.schema["page_number"].dataType.simpleString()


def _best(numbers: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties go by page, as pages are ascending."""
    if len(total) <= k:
        return np.argsort(-total, kind="stable")
    least = np.partition(total, len(total) - k)[len(total) - k]
    above = np.flatnonzero(total > least)
    return np.concatenate([above[np.argsort(-total[above], kind="stable")], np.flatnonzero(total == least)[: k - len(above)]])


def _ranked_rows(rows: DataFrame) -> DataFrame:
    """Ranks of rows of several blocks; ties go by page."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "page_number")
    return rows.withColumn("rank", F.row_number().over(w))


def _every_page(pages: DataFrame, queries: DataFrame, k1: float, b: float, fold: str, page_key: str | None) -> DataFrame:
    """query_id, document_id, page_numbers and scores, in the order of the ranking, and whole: whether these are all pages of the document or a block of them."""

    def emit(query, document, question, numbers, texts, total, whole):  # noqa: ANN001, ANN202
        order = np.argsort(-total, kind="stable")
        return [(query, document, numbers[order], total[order], whole)]

    return _scored(pages, queries, emit, f"{_named(pages, queries)}, page_numbers array<{_number(pages)}>, scores array<double>, whole boolean", k1, b, fold, page_key, PAIRS)


def rank(pages: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, fold: str = "nfkc_casefold", page_key: str | None = None) -> DataFrame:
    """Every page of the query's document: query_id, document_id, page_number, score, rank. Ties go by page."""
    every = _every_page(pages, queries, k1, b, fold, page_key)
    rows = every.select("query_id", "document_id", "whole", F.posexplode(F.arrays_zip("page_numbers", "scores")).alias("at", "p"))
    rows = rows.select("query_id", "document_id", F.col("p.page_numbers").alias("page_number"), F.col("p.scores").alias("score"), (F.col("at") + 1).alias("rank"), "whole")
    return _joined(rows)


def _joined(rows: DataFrame) -> DataFrame:
    """rows as they are where whole; ranked anew, over all blocks, where not."""
    rows = materialize(rows, "ranked")
    return rows.filter("whole").drop("whole").unionByName(_ranked_rows(rows.filter("not whole").drop("whole", "rank")))


def scores(pages: DataFrame, queries: DataFrame, **options: object) -> DataFrame:
    """query_id, document_id, page_number and score of the pages that hold a term of the query."""
    return rank(pages, queries, **options).filter("score > 0").drop("rank")


def rankings(pages: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, fold: str = "nfkc_casefold", page_key: str | None = None) -> DataFrame:
    """query_id and ranking ARRAY<INT>: every page of the query's document, by rank."""

    def emit(query, document, question, numbers, texts, total, whole):  # noqa: ANN001, ANN202
        order = np.argsort(-total, kind="stable")
        return [(query, numbers[order], None if whole else total[order], whole)]

    kind = _number(pages)
    rows = _scored(pages, queries, emit, f"query_id {queries.schema['query_id'].dataType.simpleString()}, page_numbers array<{kind}>, scores array<double>, whole boolean", k1, b, fold, page_key, PAIRS)
    rows = materialize(rows, "rankings")
    pairs = F.zip_with("page_numbers", "scores", lambda p, s: F.struct((-s).alias("s"), p.alias("p")))
    parted = rows.filter("not whole").groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("r")).select("query_id", F.col("r.p").alias("ranking"))
    return rows.filter("whole").select("query_id", F.col("page_numbers").alias("ranking")).unionByName(parted)


def zero_signals(pages: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, fold: str = "nfkc_casefold", page_key: str | None = None) -> DataFrame:
    """query_id and zero_signal: whether no page of the query's document has a score."""

    def emit(query, document, question, numbers, texts, total, whole):  # noqa: ANN001, ANN202
        return [(query, not total.any())]

    rows = _scored(pages, queries, emit, f"query_id {queries.schema['query_id'].dataType.simpleString()}, zero_signal boolean", k1, b, fold, page_key)
    return rows.groupBy("query_id").agg(F.bool_and("zero_signal").alias("zero_signal"))


def top_k(pages: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, fold: str = "nfkc_casefold", page_key: str | None = None) -> DataFrame:
    """The first k pages of rank(); a task gives k rows for each query and block of pages at most."""
    if k < 1:
        raise ValueError("k must be positive")

    def emit(query, document, question, numbers, texts, total, whole):  # noqa: ANN001, ANN202
        best = _best(numbers, total, k)
        return [(query, document, n, s, i + 1, whole) for i, (n, s) in enumerate(zip(numbers[best].tolist(), total[best].tolist()))]

    found = _scored(pages, queries, emit, f"{_named(pages, queries)}, page_number {_number(pages)}, score double, rank int, whole boolean", k1, b, fold, page_key)
    return _joined(found).filter(F.col("rank") <= k)


def nested(ranked: DataFrame) -> DataFrame:
    """query_id, ranking ARRAY<INT>, scores ARRAY<DOUBLE> and zero_signal of each query."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "page_number", "score")))
    out = ranked.groupBy("query_id").agg(rows.alias("r"), F.bool_and(F.col("score") == 0).alias("zero_signal"))
    return out.select("query_id", F.col("r.page_number").alias("ranking"), F.col("r.score").alias("scores"), "zero_signal")


def select_pages(ranked: DataFrame, budget: int) -> DataFrame:
    """query_id and pages: the first `budget` pages, in document order."""
    if not 1 <= budget <= 10:
        raise ValueError("the budget must be within 1 and 10")
    return ranked.filter(F.col("rank") <= budget).groupBy("query_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))


ANSWERS = ("answer", "evidence_pages", "confidence", "abstain", "reason")
ANSWER = "answer string, evidence_pages array<int>, confidence double, abstain boolean, reason string"


def _answerer(fold: str, minimum_coverage: float) -> Callable[[str | None, list[tuple]], tuple]:
    """answer, evidence_pages, confidence, abstain and reason of a question and its pages with their texts."""
    k1, b = 1.2, 0.75
    tokens = _tokens_of(fold)
    cut: dict[str, Counter[str]] = {}

    def counted(line: str) -> Counter[str]:
        if line not in cut:
            if len(cut) > 20_000:
                cut.clear()
            cut[line] = Counter(tokens(line))
        return cut[line]

    def one(q: str | None, held: list[tuple]) -> tuple:
        none = lambda reason: ("", [], 0.0, True, reason)
        if not (q or "").strip():
            return none("EMPTY_QUERY")
        if len(q) > LONGEST_QUESTION:
            return none("QUESTION_TOO_LONG")
        terms = list(dict.fromkeys(tokens(q)))
        if not terms:
            return none("NO_SEARCHABLE_TERMS")
        lines = [(page, t) for page, text in held for t in (text or "").split("\n") if t.strip()]
        if not lines:
            return none("NO_MATCHING_EVIDENCE")
        counts = [counted(t) for _, t in lines]
        lengths = [sum(c.values()) for c in counts]
        mean = sum(lengths) / len(lengths)
        total = [0.0] * len(lines)
        for t in terms:
            at = [(i, c[t]) for i, c in enumerate(counts) if t in c]
            idf = math.log1p((len(lines) - len(at) + 0.5) / (len(at) + 0.5))
            for i, n in at:
                total[i] += idf * n * (k1 + 1) / (n + k1 * (1 - b + b * lengths[i] / mean))
        total = [round(x, 9) for x in total]
        best = max(range(len(lines)), key=lambda i: (total[i], -i))
        if total[best] <= 0:
            return none("NO_MATCHING_EVIDENCE")
        coverage = sum(t in counts[best] for t in terms) / len(terms)
        if coverage < minimum_coverage:
            return none("INSUFFICIENT_LEXICAL_SUPPORT")
        return lines[best][1], [lines[best][0]], coverage, False, None

    return one


def extractive_answers(pages: DataFrame, queries: DataFrame, top: int = 2, minimum_coverage: float = 0.2, fold: str = "nfkc_casefold", page_key: str | None = None) -> DataFrame:
    """The best line of the best pages, or an abstention with its reason.

    query_id, answer, evidence_pages, confidence, abstain, reason. Lines of the `top` pages with the highest positive scores
    are ranked by BM25 among themselves, in one pass for each query; ties go by page and line. Coverage is the share of the
    question's tokens that the best line holds. pages: with status, if there is one; a page whose status says that it has no
    text has none. A question of more than LONGEST_QUESTION characters is refused.
    """
    if top < 1 or not 0 < minimum_coverage <= 1:
        raise ValueError("top must be positive and the coverage above 0 and at most 1")
    if "status" in pages.columns:
        pages = pages.withColumn("text", F.when(~F.lower(X.strip(F.coalesce("status", F.lit("ok")))).isin(*NO_TEXT), F.col("text")))
    made: list[Callable] = []

    def emit(query, document, question, numbers, texts, total, whole):  # noqa: ANN001, ANN202
        best = [i for i in _best(numbers, total, top) if total[i] > 0]
        if not whole:
            return [(query, document, n, s, False, *[None] * 5) for n, s in zip(numbers[best].tolist(), total[best].tolist())]
        if not made:
            made.append(_answerer(fold, minimum_coverage))
        return [(query, document, None, None, True, *made[0](question, sorted((int(numbers[i]), texts[i]) for i in best)))]

    found = materialize(_scored(pages, queries, emit, f"{_named(pages, queries)}, page_number {_number(pages)}, score double, whole boolean, {ANSWER}", 1.2, 0.75, fold, page_key), "answers")
    answered = found.filter("whole").select("query_id", *ANSWERS)
    # Pages of documents of several blocks: at most `top` for each query.
    window = _ranked_rows(found.filter("not whole").select("query_id", "document_id", "page_number", "score")).filter(F.col("rank") <= top)
    documents = F.broadcast(window.select("document_id").distinct())
    own = pages.join(documents, "document_id", "left_semi").select("document_id", "page_number", "text", *([page_key] if page_key else []))
    own = (own.dropDuplicates([page_key]) if page_key else own).select("document_id", "page_number", "text")
    texts = window.join(own, ["document_id", "page_number"])
    held = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page"), "text"))).alias("pages"))
    rows = queries.select("query_id", "question").join(answered.select("query_id"), "query_id", "left_anti").join(held, "query_id", "left")

    @F.pandas_udf(ANSWER)
    def answer(question, pages):  # noqa: ANN001, ANN202
        import pandas as pd

        one = _answerer(fold, minimum_coverage)
        return pd.DataFrame([one(q, [(p["page"], p["text"]) for p in (held if held is not None else ())]) for q, held in zip(question, pages)], columns=ANSWERS)

    return answered.unionByName(rows.select("query_id", answer("question", "pages").alias("a")).select("query_id", "a.*"))


def page_search_order(ranking: Column, pages: Column) -> Column:
    """Candidate page sets: the first four; neighbours of the first two; the first four alone; the rest by fours."""
    part = lambda a, n: F.array_sort(F.array_distinct(F.slice(ranking, a, n)))
    around = F.transform(F.slice(ranking, 1, 2), lambda p: F.sequence(F.greatest(F.lit(1), p - 1), F.least(pages, p + 1)))
    alone = F.transform(F.slice(ranking, 1, 4), lambda p: F.array(p))
    rest = F.when(pages > 4, F.transform(F.sequence(F.lit(5), pages, F.lit(4)), lambda s: F.array_sort(F.slice(ranking, s, F.lit(4))))).otherwise(F.array().cast("array<array<int>>"))
    some = lambda sets: F.filter(sets, lambda c: F.size(c) > 0)
    first = F.array_distinct(some(F.concat(F.array(part(1, 4)), around, alone)))
    # Fours of a permutation of the pages differ from each other and from the sets before, each of which holds one of the first
    # four; comparing each with each takes the square of their number.
    permutation = (F.size(F.array_distinct(ranking)) == pages) & (F.size(ranking) == pages) & (F.array_min(ranking) >= 1) & (F.array_max(ranking) <= pages)
    return F.when(permutation, F.concat(first, some(rest))).otherwise(F.array_distinct(F.concat(first, some(rest))))


def focus_pages(cited: Column, valid: Column, pages: Column) -> Column:
    """Pages of a second reading: those that a valid first one cited, if any, else all."""
    kept = F.array_intersect(pages, cited)
    return F.when(F.coalesce(valid, F.lit(False)) & (F.size(kept) > 0), kept).otherwise(pages)


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by the order columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
