"""Text: bars, colours, the chart, the summary and the status."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..history import History
from ..model import DAY, as_time, floor_to, r2
from ..plans.planner import Filters, Window, auto_bucket, check_bucket_count, plan, resolve_window
from . import readers
from .grains import grain_by

MAX_WIDTH = 500
#: The marks of a chart's series, and the colours of wait names by how they begin, as red, green, blue.
COLORS = {
    "CPU": (80, 250, 123), "IdleTx": (241, 250, 140), "IO:": (30, 100, 255), "Lock:": (255, 85, 85), "LWLock:": (255, 121, 198), "IPC:": (0, 200, 255),
    "Client:": (255, 220, 100), "Timeout:": (255, 165, 0), "BufferPin:": (0, 210, 180), "Activity:": (150, 100, 255), "Extension:": (190, 150, 255),
}
GLYPHS, OTHER = ("█", "▓", "░", "▒"), "·"
UNKNOWN = (180, 180, 180)


def escape(rgb: tuple[int, int, int]) -> str:
    """A colour switch of 19 characters whatever the colour, so that columns stay aligned."""
    return "\033[38;2;" + ";".join(f"{v:03d}" for v in rgb) + "m"


def color_of(name: str, on: bool) -> str:
    return next((escape(c) for start, c in COLORS.items() if name.startswith(start)), escape(UNKNOWN)) if on else ""


def color_column(name: Column, on: bool) -> Column:
    if not on:
        return F.lit("")
    out = F.lit(escape(UNKNOWN))
    for start, c in reversed(COLORS.items()):
        out = F.when(name.startswith(start), F.lit(escape(c))).otherwise(out)
    return out


def reset(on: bool) -> str:
    return "\033[0m" if on else ""


def clamp(width: int) -> int:
    return min(max(width, 1), MAX_WIDTH)


def bar(name: Column, pct: Column, most: Column, width: int, on: bool = False) -> Column:
    """A bar padded to width, then the percentage."""
    size = F.greatest(F.lit(1), F.coalesce(F.round(pct / F.when(most != 0, most) * clamp(width)), F.lit(1))).cast("int")
    return F.concat(color_column(name, on), F.rpad(F.repeat(F.lit("█"), size), clamp(width), " "), F.lit(reset(on)), F.lpad(F.concat(F.format_string("%.2f", pct), F.lit("%")), 8, " "))


def chart_buckets(h: History, since=None, until=None, bucket=None) -> tuple[DataFrame, Window, int]:
    """(bstart, event, cnt) with the window and bucket they are for."""
    w = resolve_window("chart", since, until, h.as_of)
    # The hourly source has no minutes by event, so events plan like a wait breakdown.
    p = plan(w, h.stats, h.as_of, auto_bucket(w.span) if bucket is None else bucket, Filters(), reader="chart", dimension="wait_event")
    check_bucket_count(p)
    if p.source == "rollup_1h":
        warnings.warn(f"chart: source rollup_1h, effective window [{p.window.start}, {p.window.end}) and bucket {p.bucket} s", stacklevel=3)
    rows = grain_by(h, p.window, "rollup_1m" if p.source == "none" else p.source, "wait_event", Filters(), p.bucket)
    return rows.select(F.col("ts").alias("bstart"), F.col("key").alias("event"), "cnt"), p.window, p.bucket


def chart_series(buckets: DataFrame, n: int) -> DataFrame:
    """(event, tot, place): the n leading events and the leader of every bucket, largest first."""
    from pyspark.sql import Window as W

    totals = buckets.groupBy("event").agg(F.sum("cnt").alias("tot"))
    ranked = totals.withColumn("place", F.row_number().over(W.orderBy(F.col("tot").desc(), F.col("event").asc())))  # one row an event
    leaders = buckets.groupBy("bstart").agg(F.max(F.struct("cnt")).alias("m")).select("bstart", F.col("m.cnt").alias("cnt"))
    first = buckets.join(leaders, ["bstart", "cnt"]).groupBy("bstart").agg(F.min("event").alias("event")).select("event").distinct()
    lead = first.withColumn("lead", F.lit(True))
    return ranked.join(lead, "event", "left").filter((F.col("place") <= max(n, 0)) | F.col("lead")).drop("lead")


CHART = "bucket_start timestamp_ntz, aas double, detail string, chart string"


def chart(h: History, since=None, until=None, bucket=None, n: int = 3, width: int = 40, color: bool = False) -> DataFrame:
    """bucket_start, aas, detail, chart: a legend row, then a stacked bar for each bucket, relative to the largest.

    A picture of at most MAX_BUCKETS lines: they are made on the cluster, by bucket
    and in long form whatever the number of series, and handed back as they are.
    """
    on, width = color or h.config.color, clamp(width)
    buckets, w, size = chart_buckets(h, since, until, bucket)
    buckets = buckets.cache()
    try:
        names = [r["event"] for r in chart_series(buckets, n).orderBy("place").collect()]  # bounded by the kinds of wait events
        lines = _chart_lines(h, buckets, w, size, names, width, on).collect() if names else []
    finally:
        buckets.unpersist()
    if not lines:
        return h.spark.createDataFrame([], CHART)
    legend = _legend(names, on)
    rows = [(None, None, None, legend), *((r["bucket_start"], r["aas"], r["detail"], r["chart"].ljust(len(legend))) for r in sorted(lines, key=lambda r: r["bucket_start"]))]
    return h.spark.createDataFrame(rows, CHART).orderBy(F.col("bucket_start").asc_nulls_first())


def _glyph(place: int) -> str:
    return GLYPHS[min(place, len(GLYPHS) - 1)]


def _legend(names: list[str], on: bool) -> str:
    return "  ".join(f"{color_of(e, on)}{g}{reset(on)} {e}" for e, g in [*((e, _glyph(i)) for i, e in enumerate(names)), ("Other", OTHER)])


def _chart_lines(h: History, buckets: DataFrame, w: Window, size: int, names: list[str], width: int, on: bool) -> DataFrame:
    """(bucket_start, aas, detail, chart) of each bucket of the window; none if nothing was counted."""
    series = h.spark.createDataFrame([(e, i, color_of(e, on) + _glyph(i)) for i, e in enumerate(names)], "event string, place int, mark string")
    secs = F.least(F.col("bstart") + size, F.lit(w.end)) - F.greatest(F.col("bstart"), F.lit(w.start))
    load = lambda c: c.cast("double") * h.interval / secs
    cells = buckets.join(F.broadcast(series), "event", "left")
    named = F.when(F.col("place").isNotNull(), F.struct("place", "event", "mark", r2(load(F.col("cnt"))).alias("v")))
    sums = cells.groupBy("bstart").agg(F.sum("cnt").alias("cnt"), F.array_sort(F.collect_list(named)).alias("parts"))
    sums = sums.withColumn("load", load(F.col("cnt"))).withColumn("total", r2(F.col("load")))
    rest = F.greatest(r2(F.col("total") - F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["v"])), F.lit(0.0))
    other = F.struct(F.lit(len(names)).alias("place"), F.lit("Other").alias("event"), F.lit(color_of("Other", on) + OTHER).alias("mark"), rest.alias("v"))
    whole = sums.withColumn("parts", F.concat("parts", F.array(other))).crossJoin(F.broadcast(sums.agg(F.max("load").alias("most")).filter("most > 0")))
    skip = len(color_of("Other", on))  # a colour is as long whatever it is
    count = lambda p: F.round(p["v"] / F.col("most") * width).cast("int")
    drawn = lambda p: F.when(count(p) > 0, F.concat(F.substring(p["mark"], 1, skip), F.repeat(F.substring(p["mark"], skip + 1, 1), count(p)), F.lit(reset(on)))).otherwise(F.lit(""))
    told = F.transform(F.filter("parts", lambda p: p["v"] > 0), lambda p: F.concat(p["event"], F.lit("="), F.format_string("%.2f", p["v"])))
    lines = whole.select("bstart", "total", F.array_join(told, " ").alias("detail"), F.array_join(F.transform("parts", drawn), "").alias("chart"))
    frame = h.spark.range(floor_to(w.start, size), w.end, size).withColumnRenamed("id", "bstart").crossJoin(F.broadcast(whole.select("most").limit(1)))
    return frame.join(lines, "bstart", "left").select(as_time(F.col("bstart")).alias("bucket_start"), F.coalesce("total", F.lit(0.0)).alias("aas"), F.coalesce("detail", F.lit("")).alias("detail"), F.coalesce("chart", F.lit("")).alias("chart"))


def summary(h: History, since=None, until=None) -> DataFrame:
    """metric, value: the headline and what leads it, as text."""
    row = readers.aas(h, since, until).first()
    schema = "metric string, value string"
    if not row["buckets_with_data"]:
        return h.spark.createDataFrame([("status", "no data in this time range")], schema)
    two = lambda v: None if v is None else f"{v:.2f}"
    out = [("period_start", str(row["period_start"])), ("period_end", str(row["period_end"])), ("source", row["source"]), ("buckets_with_data", str(row["buckets_with_data"]))]
    out += [(k, two(row[k])) for k in ("avg_aas", "peak_aas", "p99_aas", "backend_seconds")]
    waits = readers.top(h, "wait_event", since, until, n=3).collect()
    drill = waits[0] if waits else None
    out += [(f"drill_{k}", None if drill is None else str(drill[c])) for k, c in (("source", "source"), ("period_start", "period_start"), ("period_end", "period_end"), ("effective_bucket", "effective_bucket_secs"))]
    out.append(("databases_active", str(readers.top(h, "database", since, until, n=(1 << 31) - 1).count())))
    say = lambda r, name: f"{name} (avg_aas {two(r['avg_aas'])}, {two(r['pct'])}%)"
    out += [(f"top_wait_{i}", say(r, r["key"])) for i, r in enumerate(waits, 1)]
    for i, r in enumerate(readers.top(h, "query_id", since, until, n=3).collect(), 1):
        name = (r["key"] or "(other / unattributed)") + (f" — {r['query_text'][:60]}" if r["query_text"] else "")
        out.append((f"top_query_{i}", say(r, name)))
    return h.spark.createDataFrame(out, schema)


def status(h: History) -> DataFrame:
    """metric, value: settings, counts, and how far each source reaches."""
    c = h.config
    time = lambda t: None if t is None else str(h.spark.range(1).select(as_time(F.lit(t).cast("long")).alias("t")).first()["t"])
    raw = h.raw().agg(F.count_distinct("ts", "database").alias("samples"), F.max("ts").alias("last"), F.count_distinct("state", "wait_event_type", "wait_event").alias("waits"), F.count_distinct("query_id").alias("queries")).first()
    out = [("color", "on" if c.color else "off"), ("num_partitions", str(c.num_partitions)), ("sampling_enabled", str(c.sampling_enabled).lower()), ("current_slot", str(c.current_slot)), ("sample_interval_secs", f"{c.interval:g}"), ("rotation_period_days", f"{c.rotation_period.total_seconds() / DAY:g}")]
    out += [("raw_retention_days", f"{(c.num_partitions - 2) * c.rotation_period.total_seconds() / DAY:g}"), ("include_bg_workers", str(c.include_bg_workers).lower()), ("rotated_at", time(c.rotated_at))]
    out += [("last_sample_ts", time(raw["last"]) or "no samples"), ("samples_total", str(raw["samples"])), ("wait_event_map_count", str(raw["waits"])), ("wait_event_map_utilization", f"{raw['waits'] / 320:.2f}%"), ("query_map_count", str(raw["queries"]))]
    for name, rows, days in (("rollup_1m", h.minutes, c.rollup_1m_retention_days), ("rollup_1h", h.hours, c.rollup_1h_retention_days)):
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        out += [(f"{name}_rows", str(r["n"]))] + ([(f"{name}_oldest", time(r["a"])), (f"{name}_newest", time(r["b"]))] if r["n"] else [])
        out += [(f"{name}_retention", f"{days} days"), (f"{name}_retention_start", time(r["a"]) or "no rollups")]
    out += [("last_rollup_1m_ts", time(h.minute_watermark)), ("last_rollup_1h_ts", time(h.hour_watermark)), ("raw_retention_start", time(h.stats.raw_start) or "no samples")]
    out += [("debug_logging", str(c.debug_logging).lower()), *((k, str(v)) for k, v in sorted(h.counters.items()))]
    return h.spark.createDataFrame(out, "metric string, value string")
