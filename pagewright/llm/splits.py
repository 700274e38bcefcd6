"""Problem 2: train, validation and test splits that keep related records together.

Records that name one entity, in either of two columns and however it is written, are one component. Components are
found by contraction: each round, vertices are put in an order drawn by a hash of vertex and round, every vertex hooks
onto the first that it meets through an entity of the second column, and hooks are followed to their roots, which are the
next round's vertices; entities that see one root only leave. In a drawn order at most half of the vertices are expected
to be roots, however they are named and linked, so rounds grow with the logarithm of their number. A round's map holds the vertices
still alive; in the end the maps are composed backwards. Firsts are aggregated before the shuffle, joins on entities are
salted, each round is written to the shared folder, and what it no longer needs is removed.

Method of the splits: largest-differencing balance. From the histogram of the components' weights, equal weights are
dealt evenly to many bins, and the rest of each weight is a tuple of bins; the two tuples of the largest differences are
combined, largest sums with smallest, until one is left. Whole bins are then allocated to splits by the target shares.

Defined results: null and null-like ids join nothing; a record without any id is a component by itself. A component's
label is its smallest first-column entity, or its second-column entity where it has none of the first. Rows of one key
count as one record.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import discard, materialize
from .looks import NO_WIDTH

#: What stands for a missing id, in lower case.
NULL_LIKE = ("", "na", "n/a", "nan", "none", "null", "<na>")
#: Salts of joins on entities that many rows may name.
SALTS = 16
#: Bins that components are balanced over, and components of one rank bucket, at the mean.
BINS, BUCKET = 100, 50_000
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_USUAL = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def canonical_id(c: Column) -> Column:
    """One spelling of an id: usual width, lower case, no path, no .pdf, an underscore for every hyphen; null if null-like."""
    t = F.translate(F.translate(c, _WIDE, _USUAL), NO_WIDTH, "")
    t = F.lower(F.regexp_replace(t, r"^[\s   ]+|[\s   ]+$", ""))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^.*/", ""), r"\.pdf$", ""), r"[\-‐-―−﹣_]", "_")
    return F.when(~t.isin(*NULL_LIKE) & (name != ""), name)


def salted(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """A join in which rows of one key of left go to SALTS tasks; right has few rows for each key."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(right.withColumn("_salt", salts), [on, "_salt"], how).drop("_salt")


def components(records: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """key, first and second (canonical), and component of every record; see the module for labels.

    Labels carry a kind: 0 for entities of the first column, 1 for those of the second, 2 for records without any.
    """
    ids = records.select(key, canonical_id(F.col(first)).alias(first), canonical_id(F.col(second)).alias(second)).dropDuplicates([key])
    ids = materialize(ids, "ids")
    edges = ids.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.concat(F.lit("0"), first).alias("c"), F.concat(F.lit("1"), second).alias("q")).distinct()
    edges = materialize(edges, "edges")
    # Where each entity of the second column is at first: at the smallest of the first that it meets.
    place = materialize(edges.groupBy(F.col("q").alias("v")).agg(F.min("c").alias("c")), "place")
    maps: list[DataFrame] = []
    while True:
        drawn = edges.withColumn("o", F.struct(F.xxhash64(F.lit(len(maps)), "c").alias("h"), F.col("c").alias("c")))
        seen = drawn.groupBy("q").agg(F.min("o").alias("m"), F.max("o").alias("x")).filter("m < x").select("q", "m")
        live = materialize(salted(drawn, seen, "q", "c"), "live")
        discard(edges)
        if live.isEmpty():
            discard(live)
            break
        hooks = materialize(live.groupBy("c").agg(F.min("m").getField("c").alias("p")), "hooks")
        while True:
            # A root's hook is its own; once all are followed twice without a change, every vertex is at its root.
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            upper = up.select(F.col("p").alias("pp"), F.col("pp").alias("ppp"))
            jumped = materialize(hooks.join(up, "p").join(upper, "pp").select("c", F.col("ppp").alias("p"), (F.col("ppp") != F.col("p")).alias("moved")), "hooks")
            discard(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        maps.append(hooks)
        edges = materialize(salted(live.select("c", "q"), hooks.select("c", "p"), "c", "q").select(F.col("p").alias("c"), "q").distinct(), "edges")
        discard(live)
    # Roots of all vertices that ever were alive, then the smallest vertex of each root as its label.
    roots = None
    for m in reversed(maps):
        now = m.select("c", "p")
        if roots is not None:
            later = roots.select(F.col("c").alias("p"), F.col("p").alias("r"))
            now = salted(now, later, "p", "c", "left").select("c", F.coalesce("r", "p").alias("p"))
        now = materialize(now, "roots")
        discard(m, *([roots] if roots is not None else []))
        roots = now
    if roots is not None:
        labels = roots.groupBy("p").agg(F.min("c").alias("label"))
        named = materialize(salted(roots, labels, "p", "c").select("c", "label"), "labels")
        discard(roots)
        moved = salted(place, named, "c", "v", "left").select("v", F.coalesce("label", "c").alias("c"))
        place = moved.unionByName(named.select(F.col("c").alias("v"), F.col("label").alias("c")))
    vertex = F.coalesce(F.concat(F.lit("0"), first), F.concat(F.lit("1"), second), F.concat(F.lit("2"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = ids.withColumn("v", vertex).withColumn("_by", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return salted(rows, place, "v", "_by", "left").select(key, first, second, F.coalesce("c", "v").alias("component"))


def difference_bins(histogram: Sequence[tuple[int, int]], bins: int) -> tuple[list[int], dict[int, list[int]]]:
    """Sums of the bins, and for each weight the bins of the components that don't deal out evenly.

    histogram: (weight, components of that weight). Of m components of a weight, m // bins go to each bin.
    """
    heap, n, even = [], 0, 0
    for w, m in histogram:
        even += w * (m // bins)
        rest = m % bins
        if rest:
            slots = [(w, (w,))] * rest + [(0, ())] * (bins - rest)
            heap.append((-w, n, slots))
            n += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b))]
        joined.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
        n += 1
    slots = heap[0][2] if heap else [(0, ())] * bins
    rest: dict[int, list[int]] = {}
    for i, (_, node) in enumerate(slots):
        todo = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                rest.setdefault(x, []).append(i)
    return [even + s for s, _ in slots], rest


def allocate(sums: Sequence[int], shares: Sequence[tuple[str, float]]) -> list[str]:
    """The split of each bin: heaviest first, to the split that lacks most of its share."""
    whole, total = sum(sums), sum(s for _, s in shares)
    lack = {name: share / total * whole for name, share in shares}
    out = [""] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        out[i] = max(lack, key=lambda name: (lack[name], name))
        lack[out[i]] -= sums[i]
    return out


def assign(members: DataFrame, shares: Sequence[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """component, weight, bin and split of every component of members, which has a row for each record."""
    spark = members.sparkSession
    groups = materialize(members.groupBy("component").agg(F.count("*").alias("weight")), "groups")
    # Distinct weights are at most the square root of twice the records, so the histogram is small at any size.
    histogram = [(r["weight"], r["n"]) for r in groups.groupBy("weight").agg(F.count("*").alias("n")).orderBy("weight").collect()]
    sums, rest = difference_bins(histogram, bins)
    names = allocate(sums, shares)
    # As small as the histogram, and so are its arrays together: at most bins for each weight.
    deal = spark.createDataFrame(
        [(w, m // bins * bins, rest.get(w, [])) for w, m in histogram],
        T.StructType([T.StructField("weight", T.LongType()), T.StructField("even", T.LongType()), T.StructField("rest", T.ArrayType(T.IntegerType()))]),
    )
    # A component's rank among those of its weight, by buckets of a bounded number.
    buckets = max(1, -(-sum(m for _, m in histogram) // BUCKET))
    ranked = groups.withColumn("b", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    before = ranked.groupBy("weight", "b").agg(F.count("*").alias("n"))
    before = before.select("weight", "b", (F.sum("n").over(Window.partitionBy("weight").orderBy("b")) - F.col("n")).alias("before"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("weight", "b").orderBy("component")) - 1)
    ranked = ranked.join(before, ["weight", "b"]).withColumn("r", F.col("r") + F.col("before")).join(F.broadcast(deal), "weight")
    odd = F.get("rest", (F.col("r") - F.col("even")).cast("int"))
    ranked = ranked.withColumn("bin", F.when(F.col("r") < F.col("even"), F.pmod("r", F.lit(bins)).cast("int")).otherwise(odd))
    return ranked.select("component", "weight", "bin", F.element_at(F.array(*map(F.lit, names)), F.col("bin") + 1).alias("split"))


def split_records(members: DataFrame, key: str, shares: Sequence[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """key, component and split of every record; members is read twice and should be stored."""
    groups = assign(members, shares, bins).select("component", "split")
    return salted(members.select(key, "component").withColumn("_by", F.coalesce(F.col(key).cast("string"), F.lit(""))), groups, "component", "_by").select(key, "component", "split")
