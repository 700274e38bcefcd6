"""Problem 8: texts that were cut off, and how often each source cuts.

Method: a backward character n-gram model. For the last k characters of a text, k = 1 to ORDER, the model holds how often
texts end there and how often a text goes on after the same characters. The chance of an end is interpolated from short
contexts to long ones, without the text's own end; the log-odds of going on against ending are held against a threshold
for each language and column, put where their histogram is emptiest between its two modes. A field limit adds to the log-odds: the
number of a source's texts that have exactly its longest length (or fill its bytes), against the number expected there.

Contexts are 64-bit hashes made for whole batches at once. All texts are counted, each distinct text once. The contexts
that matter are those at ends: a bitmap of fixed size, built by Spark, lets others be left out early, and a join is exact.

Defined results: null, empty and blank texts are not truncated and have null log-odds. A copy of a truncated text is
truncated. A null source is a source of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .splits import salted

#: Characters of the longest context; weight of a shorter context; bits of the bitmap, as a power of 2: at least, at most.
ORDER, WEIGHT, LEAST_BITS, MOST_BITS = 8, 20.0, 20, 28
#: Contexts of fewer characters than this are those of many ends each.
SHORT = 5
#: Characters kept of an end, with room for a mark of truncation.
TAIL = 40
#: What software puts where it cuts a text; a broken character.
MARKS = r"(?:\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|\.{3}|�+))+\s*$"
#: Width of a bin of log-odds, and the bins that far values count as.
BIN, LEAST, MOST = 0.25, 8, 28
#: The threshold where a language's log-odds have no two modes; the most that a field limit adds.
USUAL, LIMIT_BONUS = 5.5, 1.5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def language(lang: Column, text: Column) -> Column:
    """ja, vi, en or another code: as declared, in any notation, else by the text's letters."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    by_text = F.when(text.rlike("[ぁ-ヺ]"), "ja").when(text.rlike("(?i)[ăâđêôơưạ-ỹ]"), "vi").otherwise("en")
    return F.when(code == "", by_text).when(code == "jp", "ja").otherwise(code)


def end_of(text: Column) -> Column:
    """The last characters of a text, without white space and marks of truncation behind."""
    tail = F.substring(F.regexp_replace(F.substring(text, -2 * TAIL, 2 * TAIL), r"[\s  　]+$", ""), -TAIL, TAIL)
    return F.regexp_replace(F.regexp_replace(tail, MARKS, ""), r"[\s  　]+$", "")


def _mixed(points: np.ndarray) -> np.ndarray:
    """Hashes of characters; digits are alike."""
    points = points.astype(np.uint64)
    points[(points >= 48) & (points <= 57)] = 48
    mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _longer(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Hashes of contexts made longer by one character before them."""
    h = (h ^ mixed) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def _number(lang: str) -> int:
    return int.from_bytes(lang.encode()[:6], "big") * 2654435761 % (1 << 61)


def _contexts(tail: Column, lang: Column) -> Column:
    """ARRAY<BIGINT>: the hashes of the last 1 to ORDER characters, fewer where the end is shorter."""

    @F.pandas_udf("array<bigint>")
    def run(tails: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for t, lang in zip(tails, langs):
            h, own = np.array([_number(lang)], np.uint64), []
            for c in _mixed(np.frombuffer((t or "")[-ORDER:].encode("utf-32-le", "surrogatepass"), np.uint32))[::-1]:
                h = _longer(h, c)
                own.append(int(h.view(np.int64)[0]))
            out.append(own)
        return pd.Series(out)

    return run(tail, lang)


def _bitmap(contexts: DataFrame) -> np.ndarray:
    """The bitmap of the contexts' hashes, sized by their number; at most 2^MOST_BITS / 64 rows reach the driver, at any size."""
    size = contexts.agg(F.count("*")).first()[0]
    bits = 1 << min(max(LEAST_BITS, (16 * size).bit_length()), MOST_BITS)
    spots = contexts.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("spot")).distinct()
    words = spots.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _goes_on(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """h and n: how often a text goes on after a context, for contexts that pass the bitmap. texts: text, lang."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part: list[tuple[str, str]] = []
            for k, pair in enumerate(zip(texts, langs)):
                part.append(pair)
                if k + 1 < len(texts) and sum(len(t) for t, _ in part[-64:]) < 400_000 and len(part) < 2_000:
                    continue
                points = np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t, _ in part])
                sizes = np.array([len(t) for t, _ in part])
                salt = np.repeat(np.array([_number(x) for _, x in part], np.uint64), sizes)
                at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                mixed, found = _mixed(points), []
                place = np.flatnonzero(at < np.repeat(sizes, sizes) - 1)
                h = salt[place]
                for k in range(ORDER):
                    # An end's context is one of an end without its first character too, so only those that were go on.
                    inside = at[place] >= k
                    place, h = place[inside], h[inside]
                    h = _longer(h, mixed[place - k])
                    spot = (h & np.uint64(len(words) * 64 - 1)).astype(np.int64)
                    hit = ((words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)) > 0
                    place, h = place[hit], h[hit]
                    found.append(h.view(np.int64))
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])
                part = []

    counts = texts.select("text", "lang").mapInArrow(run, "h bigint, n bigint")
    return counts.groupBy("h").agg(F.sum("n").alias("goes_on"))


def _log_odds(counts: Column) -> Column:
    """Log-odds of going on against ending; counts: ARRAY<STRUCT<k, ends, goes_on>> by k, with the text's own end."""

    def step(x: Column, c: Column) -> Column:
        ends = F.greatest(c["ends"] - 1, F.lit(0))
        total = ends + c["goes_on"] + WEIGHT
        # Both chances are kept: where many texts end alike, 1 - p would be 0.
        return F.struct(((ends + WEIGHT * x["p"]) / total).alias("p"), ((c["goes_on"] + WEIGHT * x["q"]) / total).alias("q"))

    return F.aggregate(F.array_sort(counts), F.struct(F.lit(0.002).alias("p"), F.lit(0.998).alias("q")), step, lambda x: F.log(x["q"] / x["p"]))


def _limits(docs: DataFrame) -> DataFrame:
    """source, unit, size and bonus: longest lengths that more of a source's texts have than is to be expected.

    Lengths count once for each text. The texts expected at the longest length are those of the tenth below it, evenly spread.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    sizes = docs.dropDuplicates(["source", "md5"]).select("source", units.alias("u")).select("source", "u.unit", "u.size")
    sizes = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    # A cut by bytes loses a broken character: up to 3 bytes are missing, or it is replaced and up to 2 are added.
    top = sizes.groupBy(F.col("source").alias("s"), F.col("unit").alias("u")).agg(F.max("size").alias("top"))
    near = sizes.join(top, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u"))).select("source", "unit", "size", "n", "top")
    slack = F.when(F.col("unit") == "bytes", 5).otherwise(0)
    at = near.groupBy("source", "unit", "top").agg(
        F.sum(F.when(F.col("size") >= F.col("top") - slack, F.col("n")).otherwise(0)).alias("at"),
        F.sum(F.when((F.col("size") < F.col("top") - slack) & (F.col("size") >= F.col("top") * 0.9), F.col("n")).otherwise(0)).alias("below"),
    )
    expected = (F.col("below") + 1) * (slack + 1) / (F.col("top") * 0.1 + 1)
    bonus = F.log(F.col("at") / expected)
    return at.filter((F.col("at") >= 3) & (bonus > 2)).select("source", "unit", (F.col("top") - slack).alias("least"), bonus.alias("bonus"))


def _threshold(histogram: list[tuple[int, int]]) -> float | None:
    """The log-odds where ends part from cuts: the emptiest place between the two modes; histogram: (bin, number), BIN wide.

    The modes are the means of both sides of the cut with the greatest variance between them. Far ends count as LEAST or MOST.
    """
    n: dict[int, int] = {}
    for x, m in histogram:
        x = min(max(x, LEAST), MOST)
        n[x] = n.get(x, 0) + m
    total, whole = sum(n.values()), sum(x * m for x, m in n.items())
    best, modes, n0, s0 = 0.0, None, 0, 0.0
    for x in sorted(n)[:-1]:
        n0, s0 = n0 + n[x], s0 + x * n[x]
        low, high = s0 / n0, (whole - s0) / (total - n0)
        between = n0 * (total - n0) * (high - low) ** 2
        if between > best:
            best, modes = between, (low, high)
    if modes is None:
        return None
    near = lambda x: sum(n.get(x + d, 0) * (3 - abs(d)) for d in (-2, -1, 0, 1, 2))
    places = range(math.ceil(modes[0]), math.floor(modes[1]) + 1)
    if not places:
        return None
    least = min(map(near, places))
    empty = [x for x in places if near(x) == least]
    return (sum(empty) / len(empty) + 0.5) * BIN


def find_truncated(df: DataFrame, key: str, text: str, lang: str, source: str, usual: float = USUAL, limit_bonus: float = LIMIT_BONUS) -> DataFrame:
    """key, source, lang, log_odds, limit_bonus, threshold and truncated of every row.

    A field limit adds limit_bonus at most, as complete texts may fill a field too. usual: the threshold without two modes.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("l"), F.col(source).alias("source"))
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\s  　​⁠﻿]")
    full = rows.filter(~blank).withColumn("lang", language(F.col("l"), F.col("text"))).withColumn("md5", F.md5(F.col("text").cast("binary")))
    light = full.select("key", "source", "lang", "md5", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), end_of(F.col("text")).alias("tail"), F.substring("text", -4, 4).contains("�").alias("broken"))
    light = materialize(light, "ends")
    # Each distinct text counts once, with the language of its smallest key.
    own = light.groupBy("md5").agg(F.min_by(F.struct("tail", "lang"), F.struct("key", "lang")).alias("t")).select("md5", "t.*")
    ends = own.groupBy("tail", "lang").agg(F.count("*").alias("n"))
    contexts = ends.select("tail", "lang", "n", F.posexplode(_contexts(F.col("tail"), F.col("lang"))).alias("k", "h"))
    contexts = materialize(contexts, "contexts")
    texts = full.groupBy("md5").agg(F.min_by(F.struct("text", "lang"), F.struct("key", "lang")).alias("t")).select("md5", "t.*")
    goes_on = _goes_on(texts, contexts)
    counts = contexts.groupBy("h").agg(F.sum("n").alias("ends")).join(goes_on, "h", "left").select("h", "ends", F.coalesce("goes_on", F.lit(0)).alias("goes_on"))
    counts = materialize(counts, "counts")
    # Short contexts are few, and many ends share them.
    few = contexts.filter(F.col("k") < SHORT - 1)
    short = salted(few, counts.join(few.select("h").distinct(), "h", "left_semi"), "h", "tail")
    long = contexts.filter(F.col("k") >= SHORT - 1).join(counts, "h")
    each = short.select("tail", "lang", "k", "ends", "goes_on").unionByName(long.select("tail", "lang", "k", "ends", "goes_on"))
    odds = each.groupBy("tail", "lang").agg(F.collect_list(F.struct("k", "ends", "goes_on")).alias("c")).select("tail", "lang", _log_odds(F.col("c")).alias("log_odds"))
    odds = materialize(odds, "odds")
    histogram: dict[str, list[tuple[int, int]]] = {}
    for r in odds.groupBy("lang", F.floor(F.col("log_odds") / BIN).cast("int").alias("b")).agg(F.count("*").alias("n")).orderBy("lang", "b").collect():
        histogram.setdefault(r["lang"], []).append((r["b"], r["n"]))
    limits = {k: x for k, h in histogram.items() if (x := _threshold(h)) is not None}
    threshold = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("lang")), F.lit(usual)) if limits else F.lit(usual)
    caps = _limits(light)
    # Odds go by text, with the language it was counted with: a copy may say another.
    by_text = materialize(salted(own, odds.withColumnRenamed("lang", "lang2"), "tail", "md5").filter(F.col("lang") == F.col("lang2")).select("md5", F.col("lang").alias("counted"), "log_odds"), "texts")
    joined = salted(light.drop("tail").withColumn("_by", F.coalesce(F.col("key").cast("string"), F.lit(""))), by_text, "md5", "_by", "left").withColumn("lang", F.coalesce("counted", "lang")).drop("counted")
    # Sources are few; their limits are at most two rows each.
    size = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    capped = joined.join(caps.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    capped = capped.groupBy("key", "source", "lang", "md5", "log_odds", "broken").agg(F.max(F.when(size >= F.col("least"), F.col("bonus"))).alias("bonus"))
    score = F.coalesce("log_odds", F.lit(9.0)) + F.least(F.coalesce("bonus", F.lit(0.0)), F.lit(limit_bonus)) + F.when(F.col("broken"), 9.0).otherwise(0.0)
    judged = capped.select("key", "source", "lang", "md5", "log_odds", F.coalesce("bonus", F.lit(0.0)).alias("limit_bonus"), threshold.alias("threshold"), (score > threshold).alias("cut"))
    judged = materialize(judged, "judged")
    copies = judged.filter("cut").select("md5").distinct().withColumn("copy", F.lit(True))
    out = salted(judged.withColumn("_by", F.coalesce(F.col("key").cast("string"), F.lit(""))), copies, "md5", "_by", "left")
    out = out.select(F.col("key").alias(key), "source", "lang", "log_odds", "limit_bonus", "threshold", F.coalesce("copy", F.lit(False)).alias("truncated"))
    none = rows.filter(blank).select(F.col("key").alias(key), "source", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("log_odds"), F.lit(0.0).alias("limit_bonus"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("truncated"))
    return out.unionByName(none)


def truncation_rates(found: DataFrame) -> DataFrame:
    """source, documents, truncated and share; a null source is one of them."""
    out = found.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("documents"))


