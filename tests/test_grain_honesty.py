"""What the hourly source may and may not claim, residual attribution, sinks and SQL."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CPU, IO, SCHEMA, T0, four_minutes, rows
from tickfold import sql
from tickfold.history import History
from tickfold.model import ROLLUP_1H, ROLLUP_1M, ActivityError, Config, seconds
from tickfold.operators import readers as R
from tickfold.operators import rollup as U
from tickfold.sources import activity

H = datetime(2026, 1, 16, 12)
HOUR = timedelta(hours=1)
ACTIVE = lambda kind, event, n: ("active", kind, event, n)


def hourly(spark, hours, minutes=None, watermark=None):
    """hours: (start, {(type, event): n}, minute totals or None)."""
    data = [(seconds(t), "db", 60, 1, [("active", *w, n) for w, n in waits.items()], [], counts) for t, waits, counts in hours]
    df = spark.createDataFrame(data, ROLLUP_1H)
    return History(spark, None, H + timedelta(days=45), minutes, df, Config(sample_interval=1), minute_watermark=watermark)


def numbers(row):
    return row["avg_aas"], row["peak_aas"], row["p99_aas"]


def test_minutes_survive_in_hours(spark):
    h = hourly(spark, [(H, {IO: 2760, CPU: 1380}, [600, *[60] * 59])])
    assert numbers(R.aas(h, H, H + HOUR).first()) == (1.15, 10.0, 4.69)
    io = R.top(h, "wait_event", H, H + HOUR).first()
    assert io["key"] == "IO:DataFileRead" and numbers(io) == (0.77, None, None)
    assert numbers(R.top(h, "database", H, H + HOUR).first()) == (1.15, 10.0, 4.69)
    ninety = R.aas(h, H, H + HOUR, bucket="90 seconds").first()
    assert (ninety["effective_bucket_secs"], ninety["buckets_expected"]) == (120, 30)
    with pytest.raises(ActivityError, match="at least 1 minute"):
        R.aas(h, H, H + HOUR, bucket=59.9)


def test_extrema_need_the_grain(spark):
    h = hourly(spark, [(H, {IO: 8280, CPU: 60}, [1260, *[120] * 59])])
    assert numbers(R.aas(h, H, H + HOUR).first()) == (2.32, 21.0, 9.79)
    by_minute = R.aas(h, H, H + HOUR, wait_event_type="IO").first()
    assert numbers(by_minute) == (2.3, None, None) and by_minute["backend_seconds"] == 8280
    assert numbers(R.aas(h, H, H + HOUR, wait_event_type="IO", bucket="1 hour").first()) == (2.3, 2.3, 2.3)
    near = R.aas(h, H, H + HOUR, wait_event_type="IO", bucket=3599.9).first()
    assert near["effective_bucket_secs"] == 3600 and near["peak_aas"] is None


def test_windows_widen_to_hours(spark):
    h = hourly(spark, [(H, {IO: 3600}, [60] * 60), (H + HOUR, {CPU: 3600}, [60] * 60)])
    half = timedelta(minutes=30)
    io = R.aas(h, H, H + half, wait_event_type="IO").first()
    assert (io["avg_aas"], io["backend_seconds"], io["period_end"]) == (1.0, 3600.0, H + HOUR)
    assert {r["key"]: r["avg_aas"] for r in R.top(h, "wait_event_type", H + half, H + HOUR + half).collect()} == {"IO": 0.5, "CPU*": 0.5}
    db = R.top(h, "database", H, H + half).first()
    assert (db["avg_aas"], db["backend_seconds"], db["peak_aas"]) == (1.0, 1800.0, 1.0)
    line = R.timeline(h, H + half, H + HOUR + half, wait_event_type="IO").collect()
    assert [(r["source"], r["data_points"], r["avg_aas"], r["peak_aas"]) for r in line] == [("rollup_1h", 1, 1.0, None), ("rollup_1h", 1, 0.0, None)]


def test_one_bad_hour_makes_the_window_flat(spark):
    h = hourly(spark, [(H, {IO: 3600}, [60] * 60), (H + HOUR, {CPU: 3600}, [60] * 59 + [None])])
    r = R.aas(h, H, H + 2 * HOUR).first()
    assert (r["source"], r["avg_aas"], r["peak_aas"]) == ("rollup_1h_flat", 1.0, None)
    assert R.aas(h, H, H + HOUR).first()["source"] == "rollup_1h"


def test_backfill(spark):
    obs = spark.createDataFrame(rows(H, [(0, IO, 1, 3), (5, CPU, 2, 2)]), SCHEMA)
    mins = U.roll_minutes(obs, Config())
    hour = U.roll_hours(mins)
    bare = hour.withColumn("minute_counts", F.lit(None).cast("array<bigint>"))
    assert [x for x in U.backfill_minutes(bare, mins).first()["minute_counts"] if x] == [3, 2]
    assert U.backfill_minutes(bare, mins.filter(F.col("ts") == seconds(H))).first()["minute_counts"] is None


def test_residual(spark):
    lead = rows(T0, [(0, IO, 111, 3), (0, IO, 222, 2), (0, IO, 333, 1), (0, IO, None, 20)])
    mins = U.roll_minutes(spark.createDataFrame(lead, SCHEMA), Config(sample_interval=60))
    assert [(p["query_id"], p["cnt"]) for p in mins.first()["query_counts"]] == [(111, 3)]
    h = History(spark, None, T0 + timedelta(hours=9), mins, None, Config(sample_interval=60))
    got = [(r["key"], r["avg_aas"], r["pct"]) for r in R.top(h, "query_id", T0, T0 + timedelta(minutes=1)).collect()]
    assert got == [(None, 23.0, 88.46), ("111", 3.0, 11.54)]
    assert R.top(h, "query_id", T0, T0 + timedelta(minutes=1), n=1).first()["key"] is None


def test_hours_keep_the_leading_hundred(spark):
    many = rows(T0, [(0, IO, q, 3) for q in range(1, 101)]) + rows(T0, [(1, CPU, q, 1) for q in range(1001, 1101)])
    mins = U.roll_minutes(spark.createDataFrame(many, SCHEMA), Config(rollup_min_backend_seconds=1))
    hour = U.roll_hours(mins).first()
    assert len(hour["query_counts"]) == 100 and sum(p["cnt"] for p in hour["query_counts"]) == 300
    assert sum(p["cnt"] for p in hour["wait_counts"]) == 400


def test_states_stay_apart(spark):
    data = [(T0, "db", s, "Client", "ClientRead", 1) for s in ("active", "idle in transaction")]
    mins = U.roll_minutes(spark.createDataFrame(data, SCHEMA), Config())
    assert [(p["state"], p["cnt"]) for p in mins.first()["wait_counts"]] == [("active", 1), ("idle in transaction", 1)]


def test_query_filters_refuse_what_raw_has_lost(spark):
    obs = spark.createDataFrame(rows(T0, [(0, IO, 1, 1)]), SCHEMA)
    old = spark.createDataFrame([(seconds(T0) - 7200, "db", 1, 1, [("active", *IO, 5)], [(1, 5)])], ROLLUP_1M)
    young = History(spark, obs, T0 + timedelta(minutes=5), config=Config(sample_interval=60))
    assert R.aas(young, T0 - 3 * HOUR, T0 + timedelta(minutes=5), query_id=1).first()["backend_seconds"] == 60
    h = History(spark, obs, T0 + timedelta(minutes=5), old, None, Config(sample_interval=60), minute_watermark=T0)
    with pytest.raises(ActivityError, match="before raw retention"):
        R.aas(h, T0 - 3 * HOUR, T0 + timedelta(minutes=5), query_id=1)
    assert R.aas(h, T0, T0 + timedelta(minutes=5), query_id=1).first()["source"] == "raw"


def test_raw_and_rollup_agree(spark):
    """The same window from raw and from minutes has the same numbers."""
    h = four_minutes(spark, rolled=True)
    only = History(spark, None, h.as_of, h.minutes, None, h.config, minute_watermark=h.as_of)
    end = T0 + timedelta(minutes=4)
    for f in ({}, {"wait_event_type": "IO"}, {"wait_event": "tuple"}, {"database": "db"}):
        assert numbers(R.aas(h, T0, end, **f).first()) == numbers(R.aas(only, T0, end, **f).first())
    for dim in ("wait_event_type", "wait_event", "database", "query_id"):
        pick = lambda x, dim=dim: sorted((str(r["key"]), *numbers(r), r["pct"]) for r in R.top(x, dim, T0, end).collect())
        assert pick(h) == pick(only)


def test_store_and_sinks(spark, tmp_path):
    h = four_minutes(spark)
    activity.append(h.rows(), str(tmp_path / "s"))
    activity.append(h.rows().limit(0), str(tmp_path / "s"))
    back = activity.read_store(spark, str(tmp_path / "s"), seconds(T0), seconds(T0) + 60)
    assert back.count() == 3 and back.columns == h.rows().columns
    activity.to_csv(R.timeline(h, T0, T0 + timedelta(minutes=4)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "bucket_start"
    activity.to_json(R.aas(h, T0, T0 + timedelta(minutes=4)), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["avg_aas"] == 4.0


def test_filters_reach_the_scan(spark, tmp_path):
    h = four_minutes(spark)
    activity.append(h.rows(), str(tmp_path / "s"))
    plan = activity.read_store(spark, str(tmp_path / "s"), seconds(T0), seconds(T0) + 60).select("database")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(sample_ts" in plan and "wait_event" not in plan.split("ReadSchema")[1]


def test_sql(spark):
    h = four_minutes(spark)
    sql.register(h, T0, T0 + timedelta(minutes=4), "t_")
    assert spark.sql("SELECT avg_aas FROM t_aas()").first()[0] == 4.0
    assert [r["key"] for r in spark.sql("SELECT key FROM t_top_wait_event_type(n => 2) ORDER BY place").collect()] == ["IO", "Lock"]
    assert spark.sql("SELECT count(*) FROM t_samples(wait => 'Lock:tuple')").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM t_timeline(at_least => 4.5)").first()[0] == 1
