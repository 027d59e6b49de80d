"""Grains: per minute or hour, how many backends were seen. All readers build on them.

A grain exists where the source has data, whatever the filters: a minute that was
sampled without a match has cnt 0 (measured zero), one that was not sampled has no
row. Filters are therefore conditions inside the sums and not on the rows, except
the database filter, which restricts coverage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import HOUR, MINUTE, display, floor_col
from ..plans.planner import Filters, Window


def wait_matches(kind: Column, event: Column, f: Filters) -> Column:
    """An event filter matches the displayed name or the bare event."""
    cond = F.lit(True)
    if f.wait_event_type is not None:
        cond = cond & (kind == f.wait_event_type)
    if f.wait_event is not None:
        cond = cond & ((display(kind, event) == f.wait_event) | (event == f.wait_event))
    return cond


def _database(rows: DataFrame, f: Filters) -> DataFrame:
    return rows if f.database is None else rows.filter(F.col("database") == f.database)


def _pair_sum(waits: Column, f: Filters) -> Column:
    return F.aggregate(waits, F.lit(0).cast("long"), lambda acc, p: acc + F.when(wait_matches(p["type"], p["event"], f), p["cnt"]).otherwise(F.lit(0)))


def minutes_valid(counts: Column, waits: Column) -> Column:
    """Whether an hour's 60 minute totals add up to its wait counts."""
    total = F.aggregate(waits, F.lit(0).cast("long"), lambda a, p: a + p["cnt"])
    by_minute = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce((F.size(counts) == 60) & (by_minute == total), F.lit(False))


def hour_details(history, w: Window) -> DataFrame:
    """(ts, database, cnt, grain): the minutes of hours that have them, one row for an hour that does not."""
    near = history.hours_in(w.start - HOUR + MINUTE, w.end).withColumn("valid", minutes_valid(F.col("minute_counts"), F.col("wait_counts")))
    mins = near.filter("valid").select("ts", "database", F.posexplode("minute_counts").alias("i", "cnt")).filter("cnt is not null")
    mins = mins.select((F.col("ts") + F.col("i") * MINUTE).alias("ts"), "database", "cnt", F.lit(MINUTE).alias("grain"))
    flat = near.filter("not valid").select("ts", "database", _pair_sum(F.col("wait_counts"), Filters()).alias("cnt"), F.lit(HOUR).alias("grain"))
    return mins.unionByName(flat).filter((F.col("ts") >= w.start) & (F.col("ts") < w.end))


def grain_counts(history, w: Window, source: str, f: Filters, size: int = MINUTE) -> DataFrame:
    """(ts, cnt): one row per grain that the source has in the window, or per stretch of ``size`` seconds that holds any (one aggregation either way)."""
    ts = F.col("ts") if size == MINUTE and source != "raw" else floor_col(F.col("ts"), size)
    if source == "raw":
        rows = _database(history.raw(w.start, w.end), f)
        hit = wait_matches(F.col("wait_event_type"), F.col("wait_event"), f)
        if f.query_id is not None:
            hit = hit & F.col("query_id").eqNullSafe(F.lit(f.query_id))
        return rows.groupBy(ts.alias("ts")).agg(F.count_if(hit).alias("cnt"))
    if source == "rollup_1h_minutes":
        return _database(hour_details(history, w), f).groupBy(ts.alias("ts")).agg(F.sum("cnt").alias("cnt"))
    if source in ("rollup_1m", "rollup_1h"):
        rows = _database((history.minutes_in if source == "rollup_1m" else history.hours_in)(w.start, w.end), f)
        return rows.groupBy(ts.alias("ts")).agg(F.sum(_pair_sum(F.col("wait_counts"), f)).alias("cnt"))
    return history.spark.createDataFrame([], "ts long, cnt long")


def dimension_key(dimension: str) -> Column:
    return {
        "wait_event_type": F.col("wait_event_type"),
        "wait_event": display(F.col("wait_event_type"), F.col("wait_event")),
        "query_id": F.col("query_id").cast("string"),
        "database": F.col("database"),
    }[dimension]


def grain_by(history, w: Window, source: str, dimension: str, f: Filters, size: int = MINUTE) -> DataFrame:
    """(ts, key, cnt): as grain_counts, by the values of a dimension; only what matches.

    Rollups keep a minute's leading queries only; what its waits count beyond
    them has the key null, never less than 0.
    """
    ts = F.col("ts") if size == MINUTE and source != "raw" else floor_col(F.col("ts"), size)
    if source == "raw":
        rows = _database(history.raw(w.start, w.end), f).filter(wait_matches(F.col("wait_event_type"), F.col("wait_event"), f))
        if f.query_id is not None:
            rows = rows.filter(F.col("query_id") == f.query_id)
        return rows.groupBy(ts.alias("ts"), dimension_key(dimension).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    if source == "rollup_1h_minutes":
        return _database(hour_details(history, w), f).groupBy(ts.alias("ts"), F.col("database").alias("key")).agg(F.sum("cnt").alias("cnt"))
    if source not in ("rollup_1m", "rollup_1h"):
        return history.spark.createDataFrame([], "ts long, key string, cnt long")
    rows = _database((history.minutes_in if source == "rollup_1m" else history.hours_in)(w.start, w.end), f)
    if dimension == "query_id":
        total = _pair_sum(F.col("wait_counts"), Filters())
        known = F.aggregate("query_counts", F.lit(0).cast("long"), lambda a, p: a + p["cnt"])
        named = F.transform("query_counts", lambda p: F.struct(p["query_id"].cast("string").alias("key"), p["cnt"].alias("cnt")))
        rest = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.greatest(total - known, F.lit(0)).alias("cnt")))
        pairs = rows.select("ts", F.inline(F.concat(named, rest)))
    elif dimension == "database":
        pairs = rows.select("ts", F.col("database").alias("key"), _pair_sum(F.col("wait_counts"), f).alias("cnt"))
    else:
        each = rows.select("ts", F.explode("wait_counts").alias("p")).select("ts", F.col("p.type").alias("wait_event_type"), F.col("p.event").alias("wait_event"), F.col("p.cnt").alias("cnt"))
        pairs = each.filter(wait_matches(F.col("wait_event_type"), F.col("wait_event"), f)).select("ts", dimension_key(dimension).alias("key"), "cnt")
    return pairs.groupBy(ts.alias("ts"), "key").agg(F.sum("cnt").alias("cnt"))
