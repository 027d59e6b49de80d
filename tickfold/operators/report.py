"""The report: load by class over the minutes of a window, its extremes, and what was behind them.

One pass pivots the minute rollup into a series per class (with zeros where a
stored minute has none of it). Extremes are minutes; what was behind them is
looked up for all sets of minutes in one join each for events and for queries.
"""

from __future__ import annotations

import json
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..history import History
from ..model import CLASSES, DAY, MINUTE, as_time, floor_col, floor_to, r2
from ..plans.planner import Filters, Window, resolve_window
from .grains import grain_counts

SETS = ("worst1m", "p99", "p999")


def class_series(h: History, w: Window) -> DataFrame:
    """(class, ts, aas): a row per class, total among them, and stored minute."""
    rows = h.minutes_in(w.start, w.end)
    of = lambda kind: F.aggregate("wait_counts", F.lit(0).cast("long"), lambda a, p: a + F.when(p["type"] == kind, p["cnt"]).otherwise(F.lit(0)))
    wide = rows.groupBy("ts").agg(*[F.sum(of(kind)).alias(k) for k, kind in CLASSES.items()])
    wide = wide.withColumn("total", sum((F.col(k) for k in CLASSES), F.lit(0)))
    entries = F.array(*[F.struct(F.lit(k).alias("class"), (F.col(k).cast("double") * h.interval / MINUTE).alias("aas")) for k in ("total", *CLASSES)])
    return wide.select("ts", F.inline(entries)).select("class", "ts", "aas")


def class_stats(series: DataFrame) -> DataFrame:
    """(class, avg, worst1m, p99, p999, worst_ts), unrounded; of equal minutes the first is the worst."""
    return series.groupBy("class").agg(
        F.avg("aas").alias("avg"), F.max("aas").alias("worst1m"), F.percentile("aas", F.lit(0.99)).alias("p99"), F.percentile("aas", F.lit(0.999)).alias("p999"),
        (-F.max(F.struct("aas", (-F.col("ts")).alias("o"))).getField("o")).alias("worst_ts"),
    )


def extreme_minutes(series: DataFrame, stats: DataFrame) -> DataFrame:
    """(set, class, ts): the worst minute, and those at or above the unrounded percentiles unless idle."""
    both = series.join(F.broadcast(stats.drop("avg", "worst1m")), "class")
    flags = F.array(
        F.when(F.col("ts") == F.col("worst_ts"), "worst1m"),
        F.when((F.col("aas") >= F.col("p99")) & (F.col("aas") > 0), "p99"),
        F.when((F.col("aas") >= F.col("p999")) & (F.col("aas") > 0), "p999"),
    )
    return both.select("class", "ts", F.explode(flags).alias("set")).filter("set is not null").select("set", "class", "ts")


def _leading(counts: DataFrame, mins: DataFrame, name: str, interval: float, n: int) -> DataFrame:
    """(set, class, name, aas, place): the n leading names by their mean load over the set's minutes."""
    from pyspark.sql import Window as W

    size = mins.groupBy("set", "class").agg(F.count_distinct("ts").alias("minutes"))
    summed = counts.groupBy("set", "class", name).agg(F.sum("cnt").alias("cnt")).filter("cnt > 0").join(size, ["set", "class"])
    order = W.partitionBy("set", "class").orderBy(F.col("cnt").desc(), F.col(name).asc())
    return summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(n, 0)).select("set", "class", name, r2(F.col("cnt") * interval / (F.col("minutes") * MINUTE), 1).alias("aas"), "place")


def top_events(h: History, w: Window, mins: DataFrame, n: int) -> DataFrame:
    """Leading events, by their bare name, of the classes whose events tell something (not cpu, not total)."""
    kinds = [k for k in CLASSES if k != "cpu"]
    rows = h.minutes_in(w.start, w.end).select("ts", F.inline("wait_counts"))
    named = rows.withColumn("class", F.coalesce(*[F.when(F.col("type") == CLASSES[k], k) for k in kinds])).filter("class is not null")
    mins = mins.filter(F.col("class").isin(*kinds))
    return _leading(named.join(mins, ["class", "ts"]).select("set", "class", "event", "cnt"), mins, "event", h.interval, n)


def top_queries(h: History, w: Window, mins: DataFrame, n: int) -> DataFrame:
    """Leading query ids from raw rows, for minutes that raw still holds; total is all classes together."""
    kinds = [k for k in CLASSES if k != "cpu"]
    mins = mins.filter(F.col("class") != "cpu")
    if h.stats.raw_oldest is None:
        mins = mins.filter(F.lit(False))
    else:
        mins = mins.filter(F.col("ts") >= floor_to(h.stats.raw_oldest, MINUTE))
    rows = h.raw(w.start, w.end).filter(F.col("query_id").isNotNull() & F.col("wait_event_type").isin(*CLASSES.values()))
    own = F.coalesce(*[F.when(F.col("wait_event_type") == CLASSES[k], k) for k in kinds])
    named = rows.select(floor_col(F.col("ts"), MINUTE).alias("ts"), "query_id", F.explode(F.array(own, F.lit("total"))).alias("class")).filter("class is not null")
    counts = named.groupBy("ts", "query_id", "class").agg(F.count(F.lit(1)).alias("cnt"))
    return _leading(counts.join(mins, ["class", "ts"]).select("set", "class", "query_id", "cnt"), mins, "query_id", h.interval, n)


def _iso(t: int | None) -> str | None:
    return None if t is None else datetime.fromtimestamp(t, timezone.utc).isoformat()


def report(h: History, since=None, until=None, vcpus: int | None = None, n: int = 3) -> dict | None:
    """The report as a document; None, with a warning that names another source if one has data, where no minute is stored. Default window: the last day."""
    w = resolve_window("report", since, until, h.as_of, DAY)
    series = class_series(h, w).cache()
    try:
        covered = series.select("ts").distinct().count()
        if not covered:
            for name in ("raw", "rollup_1h_minutes"):
                if not grain_counts(h, w, name, Filters()).isEmpty():
                    warnings.warn(f"report: no minutes are stored for the window; {name.removesuffix('_minutes')} has coverage, but report reads minutes only", stacklevel=2)
                    break
            return None
        stats = class_stats(series)
        mins = extreme_minutes(series, stats)
        out: dict = {} if vcpus is None else {"vcpus": vcpus}
        numbers = {r["class"]: r for r in stats.select("class", *[r2(F.col(c)).alias(c) for c in ("avg", *SETS)]).collect()}
        for c in ("avg", *SETS):
            out[f"aas_{c}"] = {k: numbers[k][c] for k in ("total", *CLASSES)}
        text = lambda v: f"{v:.1f}"
        events = top_events(h, w, mins, n).orderBy("place").collect()
        for s in SETS:
            out[f"top_events_{s}"] = {k: [f"{r['event']}({text(r['aas'])})" for r in events if (r["set"], r["class"]) == (s, k)] for k in CLASSES if k != "cpu"}
        queries = top_queries(h, w, mins, n).orderBy("place").collect()
        raw_from = None if h.stats.raw_oldest is None else floor_to(h.stats.raw_oldest, MINUTE)
        held = set() if raw_from is None else {(r["set"], r["class"]) for r in mins.filter((F.col("class") != "cpu") & (F.col("ts") >= raw_from)).select("set", "class").distinct().collect()}
        for s in SETS:
            found = {k: [f"{r['query_id']}({text(r['aas'])})" for r in queries if (r["set"], r["class"]) == (s, k)] for k in ("total", *CLASSES) if (s, k) in held}
            if found:
                out[f"top_queryids_{s}"] = found
        out["top_queryids_available"] = any(k.startswith("top_queryids_") for k in out)
        out["coverage"] = {"from": _iso(w.start), "to": _iso(w.end), "source": "rollup_1m", "minutes_expected": w.span // MINUTE, "minutes_with_data": covered, "raw_retention_start": _iso(h.stats.raw_start)}
        return out
    finally:
        series.unpersist()


def report_json(h: History, *args, **kwargs) -> DataFrame:
    """The report as one row with one JSON column."""
    found = report(h, *args, **kwargs)
    return h.spark.createDataFrame([(None if found is None else json.dumps(found),)], "report string")


def report_rows(h: History, *args, **kwargs) -> DataFrame:
    """The report as rows: section, item, value (text; leading names joined by commas). None where report gives none."""
    out: list[tuple[str, str, str | None]] = []
    for section, found in (report(h, *args, **kwargs) or {}).items():
        for item, value in found.items() if isinstance(found, dict) else [("", found)]:
            text = ", ".join(value) if isinstance(value, list) else f"{value:.2f}" if isinstance(value, float) else None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
            out.append((section, item, text))
    return h.spark.createDataFrame(out, "section string, item string, value string")


def series_frame(h: History, since, until) -> DataFrame:
    """The class series as a result: class, minute, aas."""
    w = resolve_window("report", since, until, h.as_of, DAY)
    return class_series(h, w).select("class", as_time(F.col("ts")).alias("minute"), r2(F.col("aas")).alias("aas"))
