"""Rollups: observations to minutes, minutes to hours; retention of all three.

Every rollup is a pure function of the rows below it, so a day that is rolled again
gives the same rows and may simply overwrite what was stored for it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DAY, HOUR, MINUTE, TOP_QUERIES, ActivityError, Config, as_seconds, floor_col, floor_to, literal_time, seconds

WAIT = ["state", "type", "event"]


def ordered_pairs(cnt: Column, *names: str) -> Column:
    """Aggregate to an array of structs, the largest cnt first, ties by the names."""
    pairs = F.array_sort(F.collect_list(F.struct((-cnt).alias("o"), *names, cnt.alias("cnt"))))
    return F.transform(pairs, lambda p: F.struct(*[p[n].alias(n) for n in names], p["cnt"].alias("cnt")))


def truncate_pairs(pairs: Column, n: int) -> Column:
    """The n leading pairs."""
    return F.slice(pairs, 1, max(n, 0)) if n > 0 else F.slice(pairs, 1, 0)


def merge_waits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: wait_counts, the sums of all arrays in column wait_counts."""
    each = rows.select(*keys, F.inline("wait_counts")).groupBy(*keys, *WAIT).agg(F.sum("cnt").alias("n"))
    return each.groupBy(*keys).agg(ordered_pairs(F.col("n"), *WAIT).alias("wait_counts"))


def leading_queries(each: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Per keys: query_counts, the TOP_QUERIES largest n of (keys, query_id, n) that are at least ``least``."""
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("query_id").asc())
    kept = each.filter(F.col("n") >= least).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP_QUERIES)
    return kept.groupBy(*keys).agg(ordered_pairs(F.col("n"), "query_id").alias("query_counts"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return left.join(renamed, cond, how).drop(*[f"{k}__" for k in keys])


#: grouping_id over (ts, database, tick, state, type, event, query_id) of the three sets: a bit for each column left out.
TICK_SET, WAIT_SET, QUERY_SET = 0b0001111, 0b0010001, 0b0011110
NO_QUERIES = "array<struct<query_id:bigint,cnt:bigint>>"


def roll_minutes(observations: DataFrame, config: Config, since=None, until=None) -> DataFrame:
    """model.ROLLUP_1M for the whole minutes in [since, until).

    Queries enter from rollup_min_backend_seconds appearances on; those without an
    id are only in the waits. Waits are told apart by state.
    """
    rows = observations
    if since is not None:
        rows = rows.filter(F.col("sample_ts") >= literal_time(floor_to(seconds(since), MINUTE)))
    if until is not None:
        rows = rows.filter(F.col("sample_ts") < literal_time(floor_to(seconds(until), MINUTE)))
    keys = ["ts", "database"]
    # One row for each tick, wait and query of a minute, and from it one pass to (minute, wait), (minute, tick) and (minute, query) together: grouping sets share the scan and the shuffle.
    base = rows.select(floor_col(as_seconds(F.col("sample_ts")), MINUTE).alias("ts"), "database", as_seconds(F.col("sample_ts")).alias("tick"), "state", F.col("wait_event_type").alias("type"), F.col("wait_event").alias("event"), "query_id")
    sets = base.groupingSets([[*keys, "tick"], [*keys, *WAIT], [*keys, "query_id"]], *keys, "tick", *WAIT, "query_id")
    parts = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")).filter(f"g <> {QUERY_SET} or (query_id is not null and n >= {int(config.rollup_min_backend_seconds)})")
    lead = Window.partitionBy(*keys).orderBy((F.col("g") == QUERY_SET).desc(), F.col("n").desc(), F.col("query_id").asc())  # queries first; the same partitioning serves the next step
    kept = parts.withColumn("place", F.when(F.col("g") == QUERY_SET, F.row_number().over(lead)).otherwise(0)).filter(F.col("place") <= TOP_QUERIES)
    of = lambda g, c: F.when(F.col("g") == g, c)
    pairs = lambda g, *names: F.array_sort(F.collect_list(of(g, F.struct((-F.col("n")).alias("o"), *names, F.col("n").alias("cnt")))))
    plain = lambda c, *names: F.transform(c, lambda p: F.struct(*[p[x].alias(x) for x in names], p["cnt"].alias("cnt")))
    whole = kept.groupBy(*keys).agg(F.count(of(TICK_SET, F.lit(1))).cast("int").alias("samples"), F.max(of(TICK_SET, F.col("n"))).cast("int").alias("peak_backends"), pairs(WAIT_SET, *WAIT).alias("w"), pairs(QUERY_SET, "query_id").alias("q"))
    return whole.select("ts", "database", "samples", "peak_backends", plain("w", *WAIT).alias("wait_counts"), plain("q", "query_id").alias("query_counts"))


def roll_hours(minutes: DataFrame, minute_watermark=None, since=None) -> DataFrame:
    """model.ROLLUP_1H from minutes, for hours that the minute watermark has passed (all hours without one).

    Keeps the leading queries without a threshold of their own, and the total of
    each stored minute; a minute that is not stored is null.
    """
    rows = minutes.withColumn("hour", floor_col(F.col("ts"), HOUR))
    if minute_watermark is not None:
        rows = rows.filter(F.col("hour") + HOUR <= floor_to(seconds(minute_watermark), MINUTE))
    if since is not None:
        rows = rows.filter(F.col("ts") >= floor_to(seconds(since), HOUR))
    keys = ["hour", "database"]
    total = F.aggregate("wait_counts", F.lit(0).cast("long"), lambda a, p: a + p["cnt"])
    plain = rows.groupBy(*keys).agg(
        F.sum("samples").cast("int").alias("samples"), F.max("peak_backends").alias("peak_backends"),
        F.map_from_entries(F.collect_list(F.struct(((F.col("ts") - F.col("hour")) / MINUTE).cast("int").alias("i"), total.alias("n")))).alias("by_minute"),
    )
    queries = leading_queries(rows.select(*keys, F.inline("query_counts")).groupBy(*keys, "query_id").agg(F.sum("cnt").alias("n")), keys)
    whole = _joined(_joined(plain, merge_waits(rows, keys), keys), queries, keys)
    minutes_of = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.try_element_at("by_minute", i))
    return whole.select(F.col("hour").alias("ts"), "database", "samples", "peak_backends", "wait_counts", F.coalesce("query_counts", F.array().cast(NO_QUERIES)).alias("query_counts"), minutes_of.alias("minute_counts"))


def rollup_minute(observations: DataFrame, config: Config, watermark, as_of, batch_limit: int = 60) -> tuple[DataFrame, int, int]:
    """One catch-up step: (rows, the new watermark, grains processed). Only whole minutes before as_of; empty ones advance the watermark too (see gap_minutes)."""
    start = floor_to(seconds(watermark), MINUTE)
    end = min(floor_to(seconds(as_of), MINUTE), start + batch_limit * MINUTE)
    end = max(start, end)
    return roll_minutes(observations, config, start, end), end, (end - start) // MINUTE


def gap_minutes(minutes: DataFrame, observations: DataFrame, start, end) -> DataFrame:
    """(ts): minutes of [start, end) that have no row though a later observation exists: rows that may have been dropped before they were rolled."""
    lo, hi = floor_to(seconds(start), MINUTE), floor_to(seconds(end), MINUTE)
    newest = observations.agg(F.max(as_seconds(F.col("sample_ts"))).alias("newest"))
    series = observations.sparkSession.range(lo, hi, MINUTE).withColumnRenamed("id", "ts")
    return series.join(minutes.select("ts"), "ts", "left_anti").crossJoin(F.broadcast(newest)).filter(F.col("newest") >= F.col("ts") + MINUTE).select("ts")


def rollup_hour(minutes: DataFrame, minute_watermark, hour_watermark, batch_limit: int = 24) -> tuple[DataFrame, int, int]:
    """As rollup_minute, for hours that the minute watermark has passed."""
    start = floor_to(seconds(hour_watermark), HOUR)
    end = max(start, min(floor_to(seconds(minute_watermark), HOUR), start + batch_limit * HOUR))
    near = minutes.filter((F.col("ts") >= start) & (F.col("ts") < end))
    return roll_hours(near, end), end, (end - start) // HOUR


def cleanup(minutes: DataFrame, hours: DataFrame, config: Config, as_of) -> tuple[DataFrame, DataFrame, str]:
    """(minutes, hours) without what retention has run out for, and what was removed."""
    now = seconds(as_of)
    keep_m = F.col("ts") >= now - config.rollup_1m_retention_days * DAY
    keep_h = F.col("ts") >= now - config.rollup_1h_retention_days * DAY
    gone = [df.filter(~keep).count() for df, keep in ((minutes, keep_m), (hours, keep_h))]
    # Fixed value: how the result is worded.
    return minutes.filter(keep_m), hours.filter(keep_h), f"cleanup: deleted {gone[0]} minute rows, {gone[1]} hourly rows"


def unrolled(observations: DataFrame, minutes: DataFrame) -> DataFrame:
    """(ts, database) of observations that the minutes lack, or have with fewer samples or a lower peak."""
    ticks = observations.groupBy(floor_col(as_seconds(F.col("sample_ts")), MINUTE).alias("ts"), "database", "sample_ts").agg(F.count(F.lit(1)).alias("n"))
    want = ticks.groupBy("ts", "database").agg(F.count(F.lit(1)).alias("ticks"), F.max("n").alias("most"))
    have = minutes.select("ts", "database", "samples", "peak_backends")
    both = _joined(want, have, ["ts", "database"])
    return both.filter("samples is null or samples < ticks or peak_backends < most").select("ts", "database")


def rotate(observations: DataFrame, minutes: DataFrame, config: Config, as_of) -> tuple[DataFrame, Config]:
    """Advance the ring: (rows that survive, the new configuration).

    Kept are the last num_partitions - 1 periods. Refuses to drop a minute of a
    database that no stored minute covers in full.
    """
    now = seconds(as_of)
    keep_from = floor_to(int(now - (config.num_partitions - 1) * config.rotation_period.total_seconds()), MINUTE)
    old = observations.filter(F.col("sample_ts") < literal_time(keep_from))
    if not unrolled(old, minutes).isEmpty():
        raise ActivityError("rotate: rows that are not rolled up would be lost; roll up first")
    return observations.filter(F.col("sample_ts") >= literal_time(keep_from)), replace(config, current_slot=(config.current_slot + 1) % config.num_partitions, rotated_at=now)


def backfill_minutes(hours: DataFrame, minutes: DataFrame) -> DataFrame:
    """Hours without valid minute detail get it from stored minutes, but only where these add up to the hour's total."""
    from .grains import minutes_valid

    total = F.aggregate("wait_counts", F.lit(0).cast("long"), lambda a, p: a + p["cnt"])
    rows = minutes.withColumn("hour", floor_col(F.col("ts"), HOUR))
    found = rows.groupBy(F.col("hour").alias("ts"), "database").agg(F.map_from_entries(F.collect_list(F.struct(((F.col("ts") - F.col("hour")) / MINUTE).cast("int").alias("i"), total.alias("n")))).alias("by_minute"))
    rebuilt = F.when(F.col("by_minute").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.try_element_at("by_minute", i)))
    both = _joined(hours, found, ["ts", "database"]).withColumn("rebuilt", rebuilt)
    keep = minutes_valid(F.col("minute_counts"), F.col("wait_counts"))
    better = minutes_valid(F.col("rebuilt"), F.col("wait_counts"))
    return both.withColumn("minute_counts", F.when(keep | ~better, F.col("minute_counts")).otherwise(F.col("rebuilt"))).drop("by_minute", "rebuilt")


def rebuild_partitions(config: Config, num_partitions: int, confirm: str) -> Config:
    """A ring of another size; raw rows are given up, rollups stay. Asks for 'yes'."""
    if confirm != "yes":
        raise ActivityError("rebuild_partitions drops all raw samples; confirm with 'yes'")
    return replace(config, num_partitions=num_partitions, current_slot=0)
