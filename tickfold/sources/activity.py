"""Sources and sinks of activity: snapshots, the events table, Parquet by day, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BACKGROUND, CLIENT, OBSERVATIONS, Config, literal_time, synthetic

STATES = ("active", "idle in transaction", "idle in transaction (aborted)")


def from_events(events: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """The events table as observations; see README for the mapping. Bounds (seconds) reach the scan as filters on ts."""
    if since is not None:
        events = events.filter(F.col("ts") >= literal_time(since))
    if until is not None:
        events = events.filter(F.col("ts") < literal_time(until))
    kind = F.col("event_type")
    pick = lambda io, lw, lock: F.when(kind == "purchase", F.lit(io)).when(kind == "signup", F.lit(lw)).when(kind == "error", F.lit(lock))
    state = F.when(kind == "click", F.lit("idle in transaction")).otherwise(F.lit("active"))
    return events.select(
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("sample_ts"),
        F.concat(F.lit("db"), (F.col("event_id") % 3).cast("string")).alias("database"),
        state.alias("state"),
        synthetic(state, pick("IO", "LWLock", "Lock")).alias("wait_event_type"),
        synthetic(state, pick("DataFileRead", "WALWrite", "tuple")).alias("wait_event"),
        F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("query_id"),
    )


def take_sample(activity: DataFrame, config: Config, own_pid: int | None = None) -> DataFrame:
    """Observations from snapshots (ts, pid, state, wait_event_type, wait_event, backend_type, query_id, database).

    Kept are the sampled states of client backends, and of background workers if
    they are included; our own backend is not. Nothing is kept while sampling is
    disabled.
    """
    kinds = [CLIENT, *(BACKGROUND if config.include_bg_workers else ())]
    rows = activity.filter(F.col("state").isin(*STATES) & F.col("backend_type").isin(*kinds))
    if own_pid is not None:
        rows = rows.filter(~F.col("pid").eqNullSafe(F.lit(own_pid)))
    if not config.sampling_enabled:
        rows = rows.filter(F.lit(False))
    return rows.select(
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("sample_ts"),
        "database",
        "state",
        synthetic(F.col("state"), F.col("wait_event_type")).alias("wait_event_type"),
        synthetic(F.col("state"), F.col("wait_event")).alias("wait_event"),
        F.col("query_id").cast("long").alias("query_id"),
    )


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, dead letters): a row without time, state or wait cannot be counted."""
    bad = F.col("sample_ts").isNull() | F.col("state").isNull() | F.col("wait_event_type").isNull() | F.col("wait_event").isNull()
    return rows.filter(~bad), rows.filter(bad)


def append(rows: DataFrame, path: str) -> None:
    """Append observations to the store: Parquet, one folder a day, sorted in each task so that row groups can be skipped."""
    rows.withColumn("day", F.to_date("sample_ts")).repartition("day", F.pmod(F.hash("sample_ts"), F.lit(16))).sortWithinPartitions("day", "sample_ts", "database").write.mode("append").partitionBy("day").parquet(path)


def read_store(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Observations of the store; bounds prune day folders and reach the scan."""
    rows = spark.read.schema(f"{OBSERVATIONS.simpleString()[7:-1].replace(':', ' ')}, day date").parquet(path)
    if since is not None:
        rows = rows.filter((F.col("day") >= F.to_date(literal_time(since))) & (F.col("sample_ts") >= literal_time(since)))
    if until is not None:
        rows = rows.filter((F.col("day") <= F.to_date(literal_time(until))) & (F.col("sample_ts") < literal_time(until)))
    return rows.drop("day")


def to_csv(result: DataFrame, path: str) -> None:
    """A reader's result as CSV with a header."""
    result.write.mode("overwrite").option("header", True).csv(path)


def to_json(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").option("ignoreNullFields", False).json(path)
