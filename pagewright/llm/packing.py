"""Problem 7: filling containers of permitted capacities with texts, sizes in tokens of a public tokenizer.

Method: variable-capacity best fit. Items come by falling size; each goes into the open container that it leaves the
least space in. Where none takes it, a container is opened, of the capacity that costs least per token it will hold: what
it will hold is foreseen by filling each permitted capacity from the sizes still to come, largest first. In the end each
container is downsized to the smallest permitted capacity of its contents. Capacities are optimised jointly over a whole
shard too: packings with all of them and with each one from the item's size up are made, and the cheapest stands.

What a container costs is a parameter, by capacity: its tokens and an overhead by default, so that unused space is least; or
any other measure, such as one that grows with the square of the length.

An item is split only where it alone exceeds the largest capacity. Items are packed in shards of a bounded number,
chosen by a hash, so no task holds an unbounded group; a shard costs less than one part-filled container for each capacity.

Defined results: null and empty texts are items of 0 tokens and are packed like others. Rows with one key are items each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard, at the mean; a documented bound on the work of a task, never on the input.
SHARD_ITEMS = 20_000
#: Tokens that a container costs besides its capacity.
OVERHEAD = 16


def default_costs(capacities: Sequence[int], overhead: int = OVERHEAD) -> dict[int, float]:
    """Each capacity's tokens and an overhead."""
    return {c: float(c + overhead) for c in capacities}


def best_fit(sizes: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int]]:
    """The container of each item, and the capacity of each container after downsizing. Each size is within the largest capacity.

    costs: the cost of a container by its capacity.
    """
    caps = sorted(costs)
    packings = [_fill(sizes, {c: costs[c] for c in caps}), *(_fill(sizes, {x: costs[x] for x in caps if x >= c}) for c in caps[1:])]
    return min(packings, key=lambda p: sum(costs[c] for c in p[1]))


def _fill(sizes: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int]]:
    caps = sorted(costs)
    top = caps[-1]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ahead = [0] * (top + 1)  # items still to come, by size
    for s in sizes:
        ahead[s] += 1
    present = sum(1 << s for s in range(1, top + 1) if ahead[s])
    open_at: list[list[int]] = [[] for _ in range(top + 1)]  # containers by free space
    mask = 0  # bit f: a container with free space f is open
    where, used = [0] * len(sizes), []

    def foreseen(room: int) -> int:
        """Tokens that items still to come would fill a room with, largest first."""
        left = room
        fits = present & ((1 << (left + 1)) - 1)
        while fits:
            s = fits.bit_length() - 1
            left -= s * min(ahead[s], left // s)
            fits = present & ((1 << min(left + 1, s)) - 1)
        return room - left

    for i in order:
        s = sizes[i]
        ahead[s] -= 1
        if s and not ahead[s]:
            present ^= 1 << s
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
        else:
            free = min((c for c in caps if c >= s), key=lambda c: (costs[c] / max(1, s + foreseen(c - s)), c))
            b = len(used)
            used.append(0)
        where[i] = b
        used[b] += s
        open_at[free - s].append(b)
        mask |= 1 << (free - s)
    return where, [next(c for c in caps if c >= u) for u in used]


def pack(sizes: DataFrame, key: str, tokens: str, costs: Mapping[int, float], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each piece: key, piece (from 0), pieces, start and tokens of the piece, container, capacity.

    sizes: stored rows; it is read twice, to count the items and to pack them. costs: the cost of a container by capacity.
    """
    top = max(costs)
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(tokens), F.lit(0)) / top)).cast("int")
    items = sizes.select(F.col(key), F.coalesce(F.col(tokens), F.lit(0)).cast("int").alias("_all"), n.alias("pieces"))
    items = items.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    items = items.withColumn("start", F.col("piece") * top).withColumn("tokens", F.least(F.lit(top), F.col("_all") - F.col("start")))
    total = items.agg(F.count("*")).first()[0]
    shards = max(1, -(-total // shard_items))
    items = items.select(key, "piece", "pieces", "start", "tokens", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)).alias("shard"))
    by_capacity = dict(costs)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable")
        where, opened = best_fit(pdf["tokens"].tolist(), by_capacity)
        shard = int(pdf["shard"].iloc[0])
        return pdf.assign(container=[shard * (1 << 32) + b for b in where], capacity=[opened[b] for b in where]).drop(columns="shard")

    kind = sizes.schema[key].dataType.simpleString()
    return items.groupBy("shard").applyInPandas(fill, f"`{key}` {kind}, piece int, pieces int, start int, tokens int, container bigint, capacity int")


def container_report(packed: DataFrame) -> DataFrame:
    """For each capacity: containers, items, tokens and unused space."""
    each = packed.groupBy("container", "capacity").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return each.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens")).withColumn("unused", F.col("containers") * F.col("capacity") - F.col("tokens"))


def split_keys(packed: DataFrame, key: str) -> DataFrame:
    """Keys of the items that the packing had to split."""
    return packed.filter(F.col("pieces") > 1).select(key).distinct()


