"""Readers of the 1.x interface, over raw observations.

Each takes since and until; the variants that took an interval are
``last(reader, history, interval, ...)``. Counts are of appearances.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..history import History
from ..model import DAY, HOUR, MINUTE, TOP_QUERIES, as_time, display, duration, floor_col, floor_to, r2, seconds
from . import readers, render


def last(reader, h: History, interval="1 hour", *args, **kwargs) -> DataFrame:
    """A reader over the interval before as_of."""
    return reader(h, h.as_of - int(duration(interval)), h.as_of, *args, **kwargs)


def _rows(h: History, since, until) -> DataFrame:
    return h.raw(seconds(since), seconds(until)).withColumn("wait", display(F.col("wait_event_type"), F.col("wait_event")))


def _shares(counts: DataFrame, key: str) -> DataFrame:
    """Adds pct, the share in all counts."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("samples").alias("all")))).withColumn("pct", r2(F.col("samples") * 100.0 / F.col("all"))).drop("all")


def _with_bar(rows: DataFrame, key: str, width: int, color: bool) -> DataFrame:
    most = rows.agg(F.max("pct").alias("most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("bar", render.bar(F.col(key), F.col("pct"), F.col("most"), width, color)).drop("most")


def top_waits(h: History, since, until, limit: int = 10, width: int = 40, color: bool = False) -> DataFrame:
    """wait_event, samples, pct, bar: the leading waits; if there are more than limit, the last row is all others together."""
    counts = _rows(h, since, until).groupBy(F.col("wait").alias("wait_event")).agg(F.count(F.lit(1)).alias("samples"))
    order = Window.orderBy(F.col("samples").desc(), F.col("wait_event").asc())  # one row a wait event
    ranked = counts.withColumn("place", F.row_number().over(order))
    size = ranked.agg(F.count(F.lit(1)).alias("kinds"))
    keep = F.col("kinds") <= limit
    named = ranked.crossJoin(F.broadcast(size)).withColumn("own", keep | (F.col("place") < limit))
    rows = named.groupBy(F.when(F.col("own"), F.col("wait_event")).otherwise("Other").alias("wait_event"), "own").agg(F.sum("samples").alias("samples"), F.min("place").alias("place"))
    shares = _shares(rows, "wait_event")
    return _with_bar(shares, "wait_event", width, color).orderBy("place").select("wait_event", "samples", "pct", "bar")


def histogram(h: History, since, until, limit: int = 10, width: int = 40) -> DataFrame:
    return top_waits(h, since, until, limit, width)


def wait_timeline(h: History, since, until, bucket="1 minute") -> DataFrame:
    """bucket_start, wait_event, samples."""
    size = int(duration(bucket))
    counts = _rows(h, since, until).groupBy(floor_col(F.col("ts"), size).alias("b"), F.col("wait").alias("wait_event")).agg(F.count(F.lit(1)).alias("samples"))
    return counts.select(as_time(F.col("b")).alias("bucket_start"), "wait_event", "samples").orderBy("bucket_start", F.col("samples").desc(), "wait_event")


def top_queries(h: History, since, until, limit: int = 10) -> DataFrame:
    """query_id, samples, pct; appearances without a query id count neither here nor in the whole."""
    counts = _rows(h, since, until).filter("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("samples"))
    return _shares(counts, "query_id").orderBy(F.col("samples").desc(), "query_id").limit(limit)


def top_queries_with_text(h: History, since, until, limit: int = 10) -> DataFrame:
    """top_queries with the text and, where statement statistics are given, calls and times."""
    rows = readers.with_query_text(h, top_queries(h, since, until, limit), "query_id", 100)
    if h.query_stats is None:
        none = F.lit(None)
        return rows.select("*", none.cast("long").alias("calls"), none.cast("double").alias("total_exec_ms"), none.cast("double").alias("mean_exec_ms")).orderBy(F.col("samples").desc(), "query_id")
    stats = h.query_stats.groupBy("query_id").agg(F.sum("calls").alias("calls"), F.sum("total_exec_ms").alias("total_exec_ms"))
    return rows.join(stats, "query_id", "left").withColumn("mean_exec_ms", r2(F.col("total_exec_ms") / F.when(F.col("calls") != 0, F.col("calls")))).orderBy(F.col("samples").desc(), "query_id")


def top_by_type(h: History, since, until, width: int = 40, color: bool = False) -> DataFrame:
    """wait_event_type, samples, pct, bar."""
    counts = _rows(h, since, until).groupBy("wait_event_type").agg(F.count(F.lit(1)).alias("samples"))
    rows = _with_bar(_shares(counts, "wait_event_type").withColumn("named", F.concat("wait_event_type", F.lit(":"))), "named", width, color)
    return rows.orderBy(F.col("samples").desc(), "wait_event_type").select("wait_event_type", "samples", "pct", "bar")


waits_by_type = top_by_type


def query_waits(h: History, query_id: int, since, until, width: int = 40, color: bool = False) -> DataFrame:
    """wait_event, samples, pct, bar of one query."""
    counts = _rows(h, since, until).filter(F.col("query_id") == query_id).groupBy(F.col("wait").alias("wait_event")).agg(F.count(F.lit(1)).alias("samples"))
    return _with_bar(_shares(counts, "wait_event"), "wait_event", width, color).orderBy(F.col("samples").desc(), "wait_event").select("wait_event", "samples", "pct", "bar")


def event_queries(h: History, event: str, since, until, limit: int = 10, width: int = 40, color: bool = False) -> DataFrame:
    """query_id, samples, pct, bar of one event: a displayed name if it has a colon, else a type or an event."""
    hit = F.col("wait") == event if ":" in event else (F.col("wait_event_type") == event) | (F.col("wait_event") == event)
    counts = _rows(h, since, until).filter(hit).groupBy("query_id").agg(F.count(F.lit(1)).alias("samples"))
    rows = _with_bar(_shares(counts, "query_id").withColumn("named", F.lit(event)), "named", width, color)
    return rows.orderBy(F.col("samples").desc(), F.col("query_id").asc_nulls_last()).limit(limit).select("query_id", "samples", "pct", "bar")


def samples_by_database(h: History, since, until) -> DataFrame:
    """database_name, samples (snapshots), total_backends."""
    ticks = _rows(h, since, until).groupBy("database", "ts").agg(F.count(F.lit(1)).alias("n"))
    return ticks.groupBy(F.coalesce("database", F.lit("<background>")).alias("database_name")).agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("total_backends")).orderBy(F.col("total_backends").desc(), "database_name")


def activity_summary(h: History, since, until) -> DataFrame:
    """metric, value: totals, average and peak, the three leading waits and queries."""
    rows = _rows(h, since, until)
    ticks = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    t = ticks.agg(F.count(F.lit(1)).alias("samples"), F.avg("n").alias("avg"), F.max(F.struct("n", (-F.col("ts")).alias("o"))).alias("peak")).first()
    schema = "metric string, value string"
    if not t["samples"]:
        return h.spark.createDataFrame([("status", "no data in this time range")], schema)
    when = h.spark.range(1).select(as_time(F.lit(-t["peak"]["o"]).cast("long")).alias("t")).first()["t"]
    out = [("total_samples", str(t["samples"])), ("avg_active_backends", f"{t['avg']:.1f}"), ("peak_active_backends", str(t["peak"]["n"])), ("peak_time", str(when)), ("databases_active", str(rows.select("database").distinct().count()))]
    out += [(f"top_wait_{i}", f"{r['wait_event']} ({r['pct']:.2f}%)") for i, r in enumerate(top_waits(h, since, until, 1 << 30).limit(3).collect(), 1)]
    out += [(f"top_query_{i}", f"{r['query_id']} ({r['pct']:.2f}%)") for i, r in enumerate(top_queries(h, since, until, 3).collect(), 1)]
    return h.spark.createDataFrame(out, schema)


def timeline_chart(h: History, since, until, bucket="1 minute", top: int = 3, width: int = 40, color: bool = False) -> DataFrame:
    """bucket_start, active, detail, chart: the chart under the names of its first form, where the load column is called active."""
    return render.chart(h, since, until, bucket, top, width, color).withColumnRenamed("aas", "active")


def samples(h: History, since, until, limit: int = 100) -> DataFrame:
    """sample_time, database_name, active_backends, wait_event, query_id, query_text; the newest first, background rows under a name of their own."""
    return readers.samples(h, since, until, limit).withColumn("database_name", F.coalesce("database_name", F.lit("<background>")))


def minute_waits(h: History, since, until, limit: int = 10) -> DataFrame:
    """minute, wait_event, samples: the leading waits of each stored minute."""
    rows = h.minutes_in(floor_to(seconds(since), MINUTE), seconds(until)).select("ts", F.inline("wait_counts"))
    counts = rows.groupBy("ts", display(F.col("type"), F.col("event")).alias("wait_event")).agg(F.sum("cnt").alias("samples"))
    order = Window.partitionBy("ts").orderBy(F.col("samples").desc(), "wait_event")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(as_time(F.col("ts")).alias("minute"), "wait_event", "samples")


def hourly_queries(h: History, since, until, limit: int = 10) -> DataFrame:
    """hour, query_id, backend_seconds, avg_backends: the leading queries of each stored hour; the average is over its samples.

    A list of TOP_QUERIES may have been cut, so an hour that has one is counted from
    raw rows. Where these do not reach back to it, its lists are all there is, and a
    warning tells.
    """
    first, end = floor_to(seconds(since), HOUR), seconds(until)
    rows, raw = h.hours_in(first, end), h.stats.raw_start
    held = F.lit(False)
    if raw is not None:
        edge = floor_to(raw, HOUR)  # raw has the whole of this hour too if nothing is stored from before it
        none = ~F.exists(F.slice("minute_counts", 1, (raw - edge) // MINUTE), lambda n: n.isNotNull())
        held = (F.col("ts") >= raw) | ((F.col("ts") == edge) & F.coalesce(none, F.lit(False)))
    hours = rows.groupBy("ts").agg(F.max("samples").alias("ticks"), F.max(F.size("query_counts") >= TOP_QUERIES).alias("cut"), F.min(held).alias("held"))
    found = hours.filter("cut").agg(F.count(F.lit(1)).alias("cut"), F.count_if("held").alias("held")).first()
    if found["cut"] > found["held"]:
        warnings.warn(f"hourly_queries: {found['cut'] - found['held']} hours from before raw retention store {TOP_QUERIES} queries a database; what was cut off is missing from their sums", stacklevel=2)
    listed = rows
    if found["held"]:
        again = F.broadcast(hours.filter("cut and held").select("ts"))
        listed = rows.join(again, "ts", "left_anti")
    each = listed.select("ts", F.inline("query_counts"))
    if found["held"]:
        near = h.raw(max(first, floor_to(raw, HOUR)), floor_to(end - 1, HOUR) + HOUR).filter("query_id is not null").select(floor_col(F.col("ts"), HOUR).alias("ts"), "query_id")
        each = each.unionByName(near.join(again, "ts", "left_semi").groupBy("ts", "query_id").agg(F.count(F.lit(1)).alias("cnt")))
    counts = each.groupBy("ts", "query_id").agg(F.sum("cnt").alias("n"))
    order = Window.partitionBy("ts").orderBy(F.col("n").desc(), "query_id")
    led = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).join(hours.select("ts", "ticks"), "ts")
    return led.select(as_time(F.col("ts")).alias("hour"), "query_id", r2(F.col("n") * F.lit(h.interval)).alias("backend_seconds"), r2(F.col("n") / F.col("ticks")).alias("avg_backends"))


def daily_peak_backends(h: History, since, until) -> DataFrame:
    """day, database, peak_backends from the hours."""
    rows = h.hours_in(floor_to(seconds(since), DAY), seconds(until))
    return rows.groupBy(floor_col(F.col("ts"), DAY).alias("d"), "database").agg(F.max("peak_backends").alias("peak_backends")).select(as_time(F.col("d")).alias("day"), "database", "peak_backends")
