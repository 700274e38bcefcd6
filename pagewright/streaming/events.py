"""Event logs: status changes, timeouts, heartbeats, progress and stages. Frames may be batch; some take streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def status_changes(log: DataFrame, job: str, ts: str, order: str, status: str) -> DataFrame:
    """Rows whose status differs from the job's row before; a job's first row is one. Nulls are a status."""
    w = Window.partitionBy(job).orderBy(ts, order)
    out = log.withColumn("_p", F.lag(status).over(w)).withColumn("_n", F.row_number().over(w))
    return out.filter((F.col("_n") == 1) | ~F.col(status).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def pending_timeouts(log: DataFrame, job: str, ts: str, order: str, pending: Column, limit_seconds: float) -> DataFrame:
    """job and timed_out_at: the first row at which a job that was pending from its start is so beyond the limit."""
    w = Window.partitionBy(job).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    out = log.withColumn("_left", F.max((~pending).cast("int")).over(w)).withColumn("_s", seconds - F.first(seconds).over(w))
    return out.filter((F.col("_left") == 0) & (F.col("_s") > limit_seconds)).groupBy(job).agg(F.min(ts).alias("timed_out_at"))


def heartbeats(log: DataFrame, job: str, ts: str, order: str, every: str = "30 seconds") -> DataFrame:
    """The first row of each job in each interval."""
    out = log.withColumn("bucket", F.window(ts, every)["start"])
    rest = [c for c in log.columns if c != job]
    return out.groupBy(job, "bucket").agg(F.min_by(F.struct(*rest), F.struct(ts, order)).alias("_r")).select(job, "bucket", "_r.*")


def progress(log: DataFrame, job: str, ts: str, order: str, total: int, emit_every: int = 1) -> DataFrame:
    """Completed, percent, rate by second and expected seconds left at every n-th row of a job."""
    w = Window.partitionBy(job).orderBy(ts, order)
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    out = log.withColumn("completed", F.row_number().over(w)).withColumn("_e", s - F.first(s).over(w))
    rate = F.when(F.col("_e") > 0, F.col("completed") / F.col("_e"))
    out = out.withColumn("percent", F.round(100.0 * F.col("completed") / total, 6)).withColumn("rate", F.round(rate, 6)).withColumn("seconds_left", F.round((total - F.col("completed")) / rate, 6))
    return out.filter((F.col("completed") % emit_every == 0) | (F.col("completed") == total)).drop("_e")


def stages(log: DataFrame, stage: str, kind: str, ts: str) -> DataFrame:
    """stage, started_at, ended_at, outcome and seconds; a stage without an end is running."""
    end = F.col(kind).isin("completed", "failed")
    out = log.groupBy(stage).agg(F.min(F.when(F.col(kind) == "started", F.col(ts))).alias("started_at"), F.max(F.when(end, F.col(ts))).alias("ended_at"), F.max_by(F.when(end, F.col(kind)), F.when(end, F.col(ts))).alias("outcome"))
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("running"))).withColumn("seconds", (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)


def deduplicated(events: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """Each event once; in a stream, within a watermark, so that the state is bounded."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def windowed_counts(events: DataFrame, ts: str, by: str, every: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts by interval and kind; in a stream, rows later than the lateness are left out, as there they must be."""
    e = events.withWatermark(ts, lateness) if events.isStreaming else events
    return e.groupBy(F.window(ts, every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def read_event_stream(spark, path: str, schema: str):  # noqa: ANN001, ANN201
    """A stream of JSON event files."""
    return spark.readStream.schema(schema).json(path)


def new_job(jobs: DataFrame, known: DataFrame, name: str, created: str, since: Column, holds: str = "") -> DataFrame:
    """The newest job made after a time that isn't known yet and whose name holds a text, in any case: one row at most; ties go by name."""
    fresh = jobs.filter((F.col(created) > since) & F.lower(F.col(name)).contains(holds.lower())).join(known.select(name), name, "left_anti")
    return fresh.orderBy(F.col(created).desc(), name).limit(1)


def active_jobs(jobs: DataFrame, name: str, status: str, active: tuple[str, ...] = ("InProgress", "Stopping")) -> DataFrame:
    """Names of jobs in one of the statuses, each once."""
    return jobs.filter(F.col(status).isin(*active) & F.col(name).isNotNull()).select(name).distinct()


def as_events(log: DataFrame, component: str, event: Column, ts: str, fields: list[str]) -> DataFrame:
    """value: a structured line for each row, with a header and the fields, sanitized; in batch or as a stream."""
    line = F.struct(F.lit(1).alias("schema_version"), text.format_utc(F.col(ts)).alias("timestamp_utc"), F.lit(component).alias("component"), event.alias("event"), *fields)
    return log.select(text.sanitize_json(F.to_json(line)).alias("value"))
