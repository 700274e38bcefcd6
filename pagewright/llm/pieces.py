"""Problem 1: splitting oversized texts at natural boundaries, with an overlap.

Method: recursive bisection. A span is cut at the strongest boundary near its midpoint (blank line, then sentence, then
white space, then between any two characters); halves that still exceed the limit less the overlap are cut again; then
each piece but the first is extended to the left by the overlap. So cores tile the text and no piece exceeds the limit.

Defined results: a text within the limit, an empty one too, is one piece with a null boundary; a null text is one piece
with null text. Repeated rows are split each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentences

KINDS = ("paragraph", "sentence", "space", "none")
#: A blank line, with the line end before it and the white space behind it.
_BLANK_LINE = re.compile("(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\\s*")
_SPACE = re.compile(r"\s+")


def _longest(text: str, cuts: list[int]) -> int:
    """The length of the longest span between cuts, without white space around it."""
    ends = [0, *cuts, len(text)]
    return max(len(text[a:b].strip()) for a, b in zip(ends, ends[1:]))


def cuts_of(text: str, starts: list[int]) -> list[list[int]]:
    """Positions where a blank line, a sentence, or white space ends, as KINDS but the last."""
    inner = lambda at: sorted({i for i in at if 0 < i < len(text)})
    return [inner(m.end() for m in _BLANK_LINE.finditer(text)), inner(starts), inner(m.end() for m in _SPACE.finditer(text))]


def boundary(text: str, cuts: list[list[int]], limit: int) -> str:
    """The first kind at which cutting, at it and the kinds before it, leaves no span over the limit."""
    all_cuts: set[int] = set()
    for kind, at in zip(KINDS, cuts):
        all_cuts.update(at)
        if _longest(text, sorted(all_cuts)) <= limit:
            return kind
    return "none"


def _nearest(at: list[int], lo: int, hi: int, mid: float) -> int | None:
    """The position strictly between lo and hi that is nearest to mid; the left of two."""
    k = bisect_left(at, mid)
    near = [x for x in (at[k - 1] if k else None, at[k] if k < len(at) else None) if x is not None and lo < x < hi]
    return min(near, key=lambda x: (abs(x - mid), x), default=None)


def _anywhere(text: str, at: int, lo: int) -> int:
    """A cut at most at `at` that doesn't part a letter from the marks that combine with it, where there is one near."""
    for x in range(at, max(lo, at - 16), -1):
        if not (unicodedata.combining(text[x]) or text[x] in "‍︎️" or text[x - 1] == "‍"):
            return x
    return at


def bisect(text: str, cuts: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Cores (start, end, kind of the cut before it; '' for the first) of a text over the limit."""
    most, out, todo = limit - overlap, [], [(0, len(text), "")]
    while todo:
        lo, hi, kind = todo.pop()
        if hi - lo <= most:
            out.append((lo, hi, kind))
            continue
        mid, quarter = (lo + hi) / 2, (hi - lo) / 4
        for a, b in ((lo + quarter, hi - quarter), (lo, hi)):
            found = next(((x, k) for k, at in zip(KINDS, cuts) if (x := _nearest(at, a, b, mid)) is not None), None)
            if found:
                break
        x, k = found or (_anywhere(text, int(mid), lo), "none")
        todo += [(x, hi, k), (lo, x, kind)]
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """key, piece (from 0), start, end, core_start, cut, boundary, piece_text: one row for each piece.

    boundary is of the whole text, and null where that is within the limit; cut is the kind of the cut before the piece.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half of the limit")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start int, end int, core_start int, cut string, boundary string, piece_text string"
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    short = rows.filter(F.col("t").isNull() | (F.length("t") <= limit)).select(
        F.col("k").alias(key), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.coalesce(F.length("t"), F.lit(0)).alias("end"),
        F.lit(0).alias("core_start"), F.lit("").alias("cut"), F.lit(None).cast("string").alias("boundary"), F.col("t").alias("piece_text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, s in zip(pdf["k"], pdf["t"], pdf["s"]):
                cuts = cuts_of(t, [int(x) for x in s])
                kind = boundary(t, cuts, limit)
                for n, (a, b, cut) in enumerate(bisect(t, cuts, limit, overlap)):
                    first = max(0, a - overlap)
                    out.append((k, n, first, b, a, cut, kind, t[first:b]))
            yield pd.DataFrame(out, columns=[key, "piece", "start", "end", "core_start", "cut", "boundary", "piece_text"])

    long = rows.filter(F.length("t") > limit).withColumn("s", sentences.starts(F.col("t"))).mapInPandas(run, schema)
    return long.unionByName(short)
