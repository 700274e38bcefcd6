"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "16m")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "pagewright-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Tables that materialize wrote, by application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/pagewright/{run}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.setdefault(run, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize returned and that no frame in use reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)
        _written[t.sparkSession.sparkContext.applicationId].remove(t._stored_at)


def release(spark: SparkSession) -> None:
    """Removes all tables that this application wrote and hasn't discarded; for when its results are stored elsewhere."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def rows_shuffled(df: DataFrame, at_least: int = 1) -> int:
    """The number of shuffle partitions of the session, which the cluster sizes to its data."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
