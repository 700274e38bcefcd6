"""Reuse of completed work: stages by content, rows by anti-join, overlays and ancestry."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.submission import digest, encode, shared_once


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: their number and the sums of two hashes of each."""
    cols = [F.to_json(F.struct(c)) for c in sorted(df.columns)]
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), big(F.xxhash64(*cols)).alias("a"), big(F.crc32(F.concat_ws("\1", *[F.coalesce(c, F.lit("\2")) for c in cols]))).alias("b")).first()
    return digest(encode([r["n"], str(r["a"]), str(r["b"])]))


def stage(spark: SparkSession, root: str, identity: dict, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored result of an identity, or a new one that is written, then named by a manifest; and whether it was there.

    root is a folder of any file system that all executors share. The manifest is written last and once, with a hash of the
    rows, which must still be that of the table; a stage without one never ran to its end and is written anew.
    """
    key = digest(encode(identity))
    folder, mark = f"{root.rstrip('/')}/{key}/data", f"{root.rstrip('/')}/{key}/manifest.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        m = json.loads(bytes(spark.read.format("binaryFile").load(mark).select("content").first()["content"]))
        if m["identity"] != identity:
            raise ValueError("a stage's manifest names another identity")
        out = spark.read.parquet(folder)
        if content_hash(out) != m["hash"]:
            raise ValueError("a stage's rows aren't those that were written")
        return out, True
    compute().write.mode("overwrite").parquet(folder)
    out = spark.read.parquet(folder)
    shared_once(spark, mark, encode({"identity": identity, "hash": content_hash(out), "rows": out.count(), "schema": out.schema.jsonValue()}))
    return out, False


def resume(todo: DataFrame, done: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored rows of the keys asked for, and computed rows of the others; a stored failure is a completed row."""
    kept = done.join(todo.select(key).distinct(), key, "left_semi")
    return kept.unionByName(compute(todo.join(done.select(key), key, "left_anti")))


def reusable(stored: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Stored rows that are ok and whose tag and size are still those listed."""
    now = listed.select(key, F.col("etag").alias("_e"), F.col("size").alias("_s"))
    return stored.join(now, key).filter((F.col("status") == "ok") & (F.col("etag") == F.col("_e")) & (F.col("size") == F.col("_s"))).drop("_e", "_s")


def overlay(base: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """Rows of base, replaced whole by the recovered row where there is one."""
    rest = [c for c in base.columns if c != key]
    r = recovered.select(key, F.struct(*rest).alias("_r"))
    out = base.select(key, F.struct(*rest).alias("_b")).join(r, key, "left")
    return out.select(key, F.coalesce("_r", "_b").alias("_x")).select(key, "_x.*")


def merge_ancestry(load: Callable[[str], tuple[DataFrame, str | None]], name: str, key: str, most: int = 64) -> DataFrame:
    """Rows of a checkpoint and its parents; a cycle, too long a chain, or two rows of one key are errors."""
    seen: list[str] = []
    frames: list[DataFrame] = []
    at: str | None = name
    while at is not None:
        if at in seen or len(seen) >= most:
            raise ValueError("the ancestry has a cycle or is too long")
        seen.append(at)
        df, at = load(seen[-1])
        frames.append(df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    out = out.distinct()
    if not out.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("checkpoints hold different rows of one key")
    return out
