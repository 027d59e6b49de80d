"""The readers: aas, timeline, periods, top, compare, samples.

Each plans first (see plans.planner) and then returns one lazy DataFrame. The unit
is AAS, average active sessions: backend seconds over the seconds of the window.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..history import History
from ..model import HOUR, MINUTE, ActivityError, as_time, display, floor_col, floor_to, r2, seconds
from ..plans.planner import DIMENSIONS, ORDERS, Filters, ReadPlan, Window, auto_bucket, check_bucket_count, plan, resolve_window
from .grains import grain_by, grain_counts, wait_matches

PERIODS = {"1m": MINUTE, "5m": 5 * MINUTE, "1h": HOUR, "1d": 24 * HOUR, "1w": 7 * 24 * HOUR, "1mo": 30 * 24 * HOUR}


def _plan(h: History, reader: str, since, until, bucket, f: Filters, dimension: str | None = None) -> ReadPlan:
    w = resolve_window(reader, since, until, h.as_of)
    size = auto_bucket(w.span) if bucket is None else bucket
    return plan(w, h.stats, h.as_of, size, f, reader=reader, dimension=dimension, has_flat=h.has_flat(f), has_coarser=h.has_coarser(f))


def _covered_secs(p: ReadPlan, bstart: Column) -> Column:
    """Seconds of the bucket that lie in the window."""
    return F.least(bstart + p.bucket, F.lit(p.window.end)) - F.greatest(bstart, F.lit(p.window.start))


def _load(h: History, p: ReadPlan, cnt: Column, bstart: Column) -> Column:
    return cnt.cast("double") * h.interval / _covered_secs(p, bstart)


def _when(flag: bool, c: Column) -> Column:
    return c if flag else F.lit(None).cast("double")


def _bounds(p: ReadPlan) -> list[Column]:
    return [as_time(F.lit(p.window.start).cast("long")).alias("period_start"), as_time(F.lit(p.window.end).cast("long")).alias("period_end"), F.lit(p.source).alias("source"), F.lit(p.bucket).cast("long").alias("effective_bucket_secs")]


def aas(h: History, since=None, until=None, wait_event_type=None, wait_event=None, query_id=None, database=None, bucket=MINUTE) -> DataFrame:
    """One row: load over the window, and peak and p99 over its covered buckets (null if the source's grain is coarser than the bucket asked for)."""
    f = Filters(wait_event_type, wait_event, query_id, database)
    p = _plan(h, "aas", since, until, bucket, f)
    per_bucket = grain_counts(h, p.window, p.read_source, f, p.bucket).withColumnRenamed("ts", "bstart")
    loads = per_bucket.select("cnt", _load(h, p, F.col("cnt"), F.col("bstart")).alias("load"))
    whole = loads.agg(F.count(F.lit(1)).alias("buckets_with_data"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.max("load").alias("peak"), F.percentile("load", F.lit(0.99)).alias("p99"))
    total = F.col("cnt").cast("double") * h.interval
    zero = F.lit(0.0)
    return whole.select(
        *_bounds(p),
        F.lit(p.buckets_expected).cast("long").alias("buckets_expected"),
        "buckets_with_data",
        r2(total / p.window.span).alias("avg_aas"),
        _when(p.extrema, F.coalesce(r2(F.col("peak")), zero)).alias("peak_aas"),
        _when(p.extrema, F.coalesce(r2(F.col("p99")), zero)).alias("p99_aas"),
        r2(total).alias("backend_seconds"),
    )


def timeline(h: History, since=None, until=None, bucket=None, wait_event_type=None, wait_event=None, query_id=None, database=None) -> DataFrame:
    """A row for each bucket of the window, also those without data; peak and p99 are over the grains inside the bucket."""
    f = Filters(wait_event_type, wait_event, query_id, database)
    p = _plan(h, "timeline", since, until, bucket, f)
    check_bucket_count(p)
    normal = grain_counts(h, p.window, p.read_source, f, p.grain).withColumnRenamed("ts", "gstart")
    grains = normal.select(floor_col(F.col("gstart"), p.bucket).alias("bstart"), "cnt", (F.col("cnt").cast("double") * h.interval / p.grain).alias("load"))
    per_bucket = grains.groupBy("bstart").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"), F.max("load").alias("peak"), F.percentile("load", F.lit(0.99)).alias("p99"))
    series = h.spark.range(floor_to(p.window.start, p.bucket), p.window.end, p.bucket).withColumnRenamed("id", "bstart")
    return series.join(per_bucket, "bstart", "left").select(
        as_time(F.col("bstart")).alias("bucket_start"),
        F.lit(p.source).alias("source"),
        F.coalesce("n", F.lit(0)).cast("long").alias("data_points"),
        r2(_load(h, p, F.col("cnt"), F.col("bstart"))).alias("avg_aas"),
        _when(p.extrema, r2(F.col("peak"))).alias("peak_aas"),
        _when(p.extrema, r2(F.col("p99"))).alias("p99_aas"),
    ).orderBy("bucket_start")


def periods(h: History, until=None) -> DataFrame:
    """aas over the usual trailing windows, one row each; windows that read the same source share one scan, of the longest."""
    end = h.as_of if until is None else seconds(until)
    plans = {name: _plan(h, "aas", end - size, end, MINUTE, Filters()) for name, size in PERIODS.items()}
    found = None
    for source, bucket in dict.fromkeys((p.read_source, p.bucket) for p in plans.values()):
        alike = {n: p.window for n, p in plans.items() if (p.read_source, p.bucket) == (source, bucket)}
        widest = Window(min(w.start for w in alike.values()), max(w.end for w in alike.values()))
        rows = grain_counts(h, widest, source, Filters(), bucket)
        windows = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(w.start).alias("lo"), F.lit(w.end).alias("hi")) for n, w in alike.items()])
        each = rows.select("ts", "cnt", F.explode(F.filter(windows, lambda w: (F.col("ts") + bucket > w["lo"]) & (F.col("ts") < w["hi"]))).alias("w"))
        load = F.col("cnt").cast("double") * h.interval / (F.least(F.col("ts") + bucket, F.col("w.hi")) - F.greatest(F.col("ts"), F.col("w.lo")))
        part = each.groupBy(F.col("w.period").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"), F.max(load).alias("peak"), F.percentile(load, F.lit(0.99)).alias("p99"))
        found = part if found is None else found.unionByName(part)
    facts = [(i, n, p.window.start, p.window.end, p.source, p.bucket, p.buckets_expected, p.extrema) for i, (n, p) in enumerate(plans.items())]
    frame = h.spark.createDataFrame(facts, "place int, period string, lo long, hi long, source string, bucket long, expected long, extrema boolean")
    total = F.coalesce("cnt", F.lit(0)).cast("double") * h.interval
    extreme = lambda c: F.when(F.col("extrema"), F.coalesce(r2(F.col(c)), F.lit(0.0)))
    return frame.join(found, F.col("period") == F.col("k"), "left").orderBy("place").select(
        "period", as_time(F.col("lo")).alias("period_start"), as_time(F.col("hi")).alias("period_end"), "source", F.col("bucket").alias("effective_bucket_secs"), F.col("expected").alias("buckets_expected"),
        F.coalesce("n", F.lit(0)).cast("long").alias("buckets_with_data"), r2(total / (F.col("hi") - F.col("lo"))).alias("avg_aas"), extreme("peak").alias("peak_aas"), extreme("p99").alias("p99_aas"), r2(total).alias("backend_seconds"),
    )


def _keyed(h: History, p: ReadPlan, dimension: str, f: Filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loads by key and bucket, totals by key, the number of covered buckets)."""
    by_bucket = grain_by(h, p.window, p.read_source, dimension, f, p.bucket).withColumnRenamed("ts", "bstart")
    totals = by_bucket.groupBy("key").agg(F.sum("cnt").alias("total")).filter("total > 0")
    covered = grain_counts(h, p.window, p.read_source, f.only_database(), p.bucket).agg(F.count(F.lit(1)).alias("covered"))
    return by_bucket, totals, covered


def _ranked(h: History, p: ReadPlan, dimension: str, f: Filters, n: int | None, order_by: str = "avg") -> DataFrame:
    """key, total, avg_aas, peak_aas, p99_aas, backend_seconds, pct; the first n (all without n) by the order, ties by key.

    The zero buckets of a key enter its percentile as one row with their number as
    frequency, so the frame of keys and buckets is never laid out.
    """
    by_bucket, totals, covered = _keyed(h, p, dimension, f)
    grand = totals.agg(F.sum("total").alias("grand"))
    keys = totals
    if n is not None and (order_by == "avg" or not p.extrema):
        keys = totals.orderBy(F.col("total").desc(), F.col("key").asc_nulls_last()).limit(max(n, 0))
    if p.extrema:
        kept = keys.select(F.col("key").alias("k"))
        seen = by_bucket.join(kept, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("key", _load(h, p, F.col("cnt"), F.col("bstart")).alias("load"), F.lit(1).cast("long").alias("times"))
        n_seen = seen.groupBy("key").agg(F.sum("times").alias("seen"))
        zeros = n_seen.crossJoin(F.broadcast(covered)).select("key", F.lit(0.0).alias("load"), (F.col("covered") - F.col("seen")).alias("times")).filter("times > 0")
        shape = seen.unionByName(zeros).groupBy("key").agg(F.max("load").alias("peak"), F.percentile("load", F.lit(0.99), F.col("times")).alias("p99"))
        whole = keys.join(shape.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).drop("k")
    else:
        whole = keys.withColumns({"peak": F.lit(None).cast("double"), "p99": F.lit(None).cast("double")})
    out = whole.crossJoin(F.broadcast(grand)).select(
        "key", "total",
        r2(F.col("total").cast("double") * h.interval / p.window.span).alias("avg_aas"), r2(F.col("peak")).alias("peak_aas"), r2(F.col("p99")).alias("p99_aas"),
        r2(F.col("total").cast("double") * h.interval).alias("backend_seconds"), r2(F.col("total") * F.lit(100.0) / F.col("grand")).alias("pct"),
    )
    first = {"avg": "total", "peak": "peak_aas", "p99": "p99_aas"}[order_by]
    ordered = out.orderBy(F.col(first).desc_nulls_last(), F.col("total").desc(), F.col("key").asc_nulls_last())
    return ordered if n is None else ordered.limit(max(n, 0))


def with_query_text(h: History, rows: DataFrame, key: str, width: int) -> Column | DataFrame:
    if h.query_texts is None:
        return rows.withColumn("query_text", F.lit(None).cast("string"))
    texts = h.query_texts.groupBy(F.col("query_id").cast("string").alias("qt_key")).agg(F.min("query").alias("q"))
    return rows.join(texts, F.col(key).cast("string") == F.col("qt_key"), "left").withColumn("query_text", F.substring("q", 1, width)).drop("qt_key", "q")


def _check_top(dimension: str | None, order_by: str = "avg") -> None:
    if dimension is not None and dimension not in DIMENSIONS:
        raise ActivityError(f"dimension must be one of {', '.join(DIMENSIONS)}, got {dimension}")
    if order_by not in ORDERS:
        raise ActivityError(f"order_by must be one of {', '.join(ORDERS)}, got {order_by}")


def top(h: History, dimension: str = "wait_event_type", since=None, until=None, wait_event_type=None, wait_event=None, query_id=None, database=None, n: int = 10, bucket=MINUTE, order_by: str = "avg") -> DataFrame:
    """The n leading values of a dimension. pct is of all keys; peak and p99 are over all buckets that the source covers, as zero where the key is absent."""
    _check_top(dimension, order_by)
    f = Filters(wait_event_type, wait_event, query_id, database)
    p = _plan(h, "top", since, until, bucket, f, dimension)
    rows = _ranked(h, p, dimension, f, n, order_by)
    rows = with_query_text(h, rows, "key", 100) if dimension == "query_id" else rows.withColumn("query_text", F.lit(None).cast("string"))
    first = {"avg": "total", "peak": "peak_aas", "p99": "p99_aas"}[order_by]
    return rows.orderBy(F.col(first).desc_nulls_last(), F.col("total").desc(), F.col("key").asc_nulls_last()).select("key", "query_text", *[c.alias(n_) for c, n_ in zip(_bounds(p), ("period_start", "period_end", "source", "effective_bucket_secs"), strict=True)], "avg_aas", "peak_aas", "p99_aas", "backend_seconds", "pct")


def compare(h: History, since_1, until_1, since_2, until_2, dimension: str | None = None, n: int = 10, wait_event_type=None, wait_event=None, query_id=None, database=None, bucket=MINUTE) -> DataFrame:
    """Two windows side by side, overall or by the n keys that changed most. Extrema are null on both sides if the two grains differ."""
    _check_top(dimension)
    f = Filters(wait_event_type, wait_event, query_id, database)
    plans = [_plan(h, "compare", s, u, bucket, f, dimension) for s, u in ((since_1, until_1), (since_2, until_2))]
    covered = [not grain_counts(h, p.window, p.read_source, f.only_database()).isEmpty() for p in plans]
    for i, ok in enumerate(covered, 1):
        if not ok:
            warnings.warn(f"compare: window {i} has no data", stacklevel=2)
    like = all(p.extrema for p in plans) and plans[0].grain == plans[1].grain and plans[0].bucket == plans[1].bucket
    sides = []
    for i, (p, s, u, ok) in enumerate(zip(plans, (since_1, since_2), (until_1, until_2), covered, strict=True), 1):
        if dimension is None:
            rows = aas(h, s, u, wait_event_type, wait_event, query_id, database, bucket).select(F.lit(None).cast("string").alias("key"), "avg_aas", "peak_aas", "p99_aas", "backend_seconds", F.lit(None).cast("double").alias("pct"))
            if not ok:
                rows = rows.select("key", *[F.lit(None).cast("double").alias(c) for c in rows.columns[1:]])
        else:
            rows = _ranked(h, p, dimension, f, None).drop("total")
        if not like:
            rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("peak_aas", "p99_aas")})
        sides.append(rows.select(*[F.col(c).alias(f"{c}_{i}") for c in rows.columns]))
    both = sides[0].join(sides[1], F.col("key_1").eqNullSafe(F.col("key_2")), "full_outer")
    zero = F.lit(0.0)
    delta = r2(F.coalesce("avg_aas_2", zero) - F.coalesce("avg_aas_1", zero)) if all(covered) else F.lit(None).cast("double")
    out = both.select(
        F.coalesce("key_1", "key_2").alias("key"),
        *[F.lit(getattr_).alias(f"{name}_{i}") for i, p in enumerate(plans, 1) for name, getattr_ in (("source", p.source),)],
        *[F.lit(p.bucket).cast("long").alias(f"effective_bucket_secs_{i}") for i, p in enumerate(plans, 1)],
        "avg_aas_1", "avg_aas_2", delta.alias("delta"),
        "peak_aas_1", "peak_aas_2", "p99_aas_1", "p99_aas_2", "backend_seconds_1", "backend_seconds_2", "pct_1", "pct_2",
    )
    if dimension is None:
        return out
    size = F.abs(F.coalesce("avg_aas_2", zero) - F.coalesce("avg_aas_1", zero))
    return out.orderBy(size.desc(), F.greatest(F.coalesce("avg_aas_1", zero), F.coalesce("avg_aas_2", zero)).desc(), F.col("key").asc_nulls_last()).limit(max(n, 0))


def samples(h: History, since=None, until=None, n: int = 100, wait_event_type=None, wait_event=None, query_id=None, database=None) -> DataFrame:
    """Raw rows, newest first. Bounds count to the second; active_backends is what the whole snapshot of that database had."""
    f = Filters(wait_event_type, wait_event, query_id, database)
    until, since = h.as_of if until is None else seconds(until), seconds(since)
    since = until - HOUR if since is None else since
    if since > until:
        raise ActivityError("samples: since must be less than or equal to until")
    rows = h.rows(since, until)
    if database is not None:
        rows = rows.filter(F.col("database") == database)
    active = rows.groupBy(F.col("sample_ts").alias("s"), F.col("database").alias("d")).agg(F.count(F.lit(1)).alias("active_backends"))
    hit = rows.filter(wait_matches(F.col("wait_event_type"), F.col("wait_event"), f))
    if query_id is not None:
        hit = hit.filter(F.col("query_id") == query_id)
    picked = hit.select("sample_ts", "database", display(F.col("wait_event_type"), F.col("wait_event")).alias("wait_event"), "query_id")
    order = [F.col("sample_ts").desc(), F.col("wait_event").asc(), F.col("database").asc_nulls_last(), F.col("query_id").asc_nulls_last()]
    first = picked.orderBy(*order).limit(max(n, 0))
    # Only the snapshots of the rows returned are counted.
    whole = active.join(F.broadcast(first.select("sample_ts", "database").distinct()), (F.col("s") == F.col("sample_ts")) & F.col("d").eqNullSafe(F.col("database")), "left_semi")
    out = with_query_text(h, first.join(F.broadcast(whole), (F.col("s") == F.col("sample_ts")) & F.col("d").eqNullSafe(F.col("database"))), "query_id", 80)
    return out.orderBy(*order).select(F.col("sample_ts").alias("sample_time"), F.col("database").alias("database_name"), "active_backends", "wait_event", "query_id", "query_text")
