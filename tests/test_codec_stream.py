"""Packed samples, the continuous store, legacy readers and the planner."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import T0, four_minutes
from tickfold.functions import codec
from tickfold.model import ActivityError, Config, duration, floor_to, seconds
from tickfold.operators import legacy, readers
from tickfold.plans.planner import SourceStats, Window, pick_source, pick_source_agg
from tickfold.streaming import stream

END = T0 + timedelta(minutes=4)


def test_codec_negatives(spark):
    good = [[-1, 1, 0], [-2, 2, 5, 0, -1, 1, 7]]
    bad = [None, [], [-1, 1], [1, 1, 1], [-1, 0, 1], [-1, -2, 1], [-1, 3, 1, 2], [-1, 1, -5], [-1, 1, None], [-1, 1, 2, -3], [-1, 1, 2, 3]]
    df = spark.createDataFrame([(x,) for x in good + bad], "data array<int>")
    got = df.select(codec.is_valid(F.col("data")).alias("ok"), codec.unpack(F.col("data")).alias("u")).collect()
    assert [r["ok"] for r in got] == [True] * 2 + [False] * len(bad)
    assert [tuple(x) for x in got[1]["u"]] == [(2, 5), (2, 0), (1, 7)] and all(r["u"] == [] for r in got[2:])


def test_codec_round_trip(spark):
    h = four_minutes(spark)
    waits, queries = codec.build_dictionaries(h.rows())
    packed = codec.encode(h.rows(), waits, queries)
    assert packed.count() == 4 and packed.agg(F.sum("active_count")).first()[0] == 16
    back = codec.decode(packed, waits, queries)
    want = h.rows().groupBy("sample_ts", "wait_event_type", "query_id").count().count()
    assert back.count() == 16 and back.groupBy("sample_ts", "wait_event", "query_id").count().count() == want
    assert sorted((r["wait_event"], r["query_id"]) for r in codec.decode_at(packed, waits, queries, T0).collect()) == [("CPU*", 10101), ("IO:DataFileRead", 10101), ("IO:DataFileRead", 20202)]
    broken = packed.withColumn("data", F.array(F.lit(1), F.lit(2), F.lit(3)))
    with pytest.warns(UserWarning, match="malformed"):
        assert codec.decode(broken, waits, queries).count() == 0


def test_register_cap(spark):
    known = spark.createDataFrame([(1, 7)], "id int, query_id long")
    got = codec.register(known, spark.createDataFrame([(7,), (8,), (9,)], "query_id long"), ["query_id"], 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7), (2, 8)]


def snapshot(minute, pid, state="active", kind=None, event=None, backend="client backend", query=1, second=0):
    return (T0 + timedelta(minutes=minute, seconds=second), pid, state, kind, event, backend, query, "db")


def test_stream(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), stream.Store(spark, str(tmp_path / "store"), Config(sample_interval=60, rollup_min_backend_seconds=1))
    first = [snapshot(0, 1), snapshot(0, 2, "idle"), snapshot(0, 3, backend="autovacuum worker"), snapshot(1, 1, "idle in transaction"), snapshot(2, 1, kind="IO", event="DataFileRead")]
    spark.createDataFrame(first, stream.SNAPSHOT).coalesce(1).write.parquet(f"{inbox}/a")
    read = lambda: spark.readStream.schema(stream.SNAPSHOT).parquet(f"{inbox}/*")
    q = stream.start(read(), store, str(tmp_path / "cp"))
    q.awaitTermination()
    assert store.observations().count() == 3
    assert store.rollup("rollup_1m").count() == 1  # minute 1 is the watermark
    spark.createDataFrame([snapshot(50, 1), snapshot(55, 2), (None, 1, "active", None, None, "client backend", 1, "db")], stream.SNAPSHOT).coalesce(1).write.parquet(f"{inbox}/b")
    q = stream.start(read(), store, str(tmp_path / "cp"))
    q.awaitTermination()
    assert store.rollup("rollup_1m").count() == 4 and store.rollup("rollup_1h").count() == 1
    store.ingest(spark.createDataFrame([snapshot(50, 1), snapshot(55, 2)], stream.SNAPSHOT), 1)  # the same batch again
    assert store.observations().count() == 5 and store.rollup("rollup_1m").count() == 4
    h = store.history(T0 + timedelta(minutes=56))
    assert readers.aas(h, T0, T0 + timedelta(minutes=3)).first()["avg_aas"] == 1.0
    assert {r["wait_event_type"] for r in store.observations().collect()} == {"CPU*", "IdleTx", "IO"}
    far = seconds(T0) + 40 * 86400
    assert store.retain(far) == ["rollup_1m/2026-03-02"]  # raw is not rolled up to its end yet


def test_windowed_minutes(spark, tmp_path):
    from tests.fixtures import SCHEMA, rows

    spark.createDataFrame(rows(T0, [(0, ("IO", "DataFileRead"), 1, 3), (1, ("IO", "DataFileRead"), 1, 1), (30, ("CPU*", "CPU*"), 1, 1)]), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stream.windowed_minutes(read).writeStream.format("memory").queryName("mins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["cnt"] for r in spark.table("mins").collect()) == [1, 3]
    assert "numInputRows" in stream.describe(q)


def test_uninstall(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "gone"), Config())
    store.ingest(spark.createDataFrame([snapshot(0, 1)], stream.SNAPSHOT), 0)
    with pytest.raises(ActivityError):
        store.uninstall("no")
    store.uninstall("yes")
    assert not (tmp_path / "gone").exists()


def test_intervals():
    assert stream.check_interval("5 seconds") and stream.check_interval("2 hours")
    for bad in ("0 seconds", "60 seconds", "24 hours", "1 day"):
        with pytest.raises(ActivityError):
            stream.check_interval(bad)


def test_legacy(spark):
    h = four_minutes(spark, rolled=True)
    got = [(r["wait_event"], r["samples"]) for r in legacy.top_waits(h, T0, END, limit=2).collect()]
    assert got == [("IO:DataFileRead", 7), ("Other", 9)]
    assert [r["wait_event"] for r in legacy.last(legacy.top_waits, h, "4 minutes").collect()] == ["IO:DataFileRead", "Lock:tuple", "CPU*"]
    assert [(r["query_id"], r["samples"], r["pct"]) for r in legacy.top_queries(h, T0, END).collect()] == [(20202, 6, 40.0), (30303, 5, 33.33), (10101, 4, 26.67)]
    assert [(r["wait_event"], r["samples"]) for r in legacy.query_waits(h, 10101, T0, END).collect()] == [("CPU*", 3), ("IO:DataFileRead", 1)]
    assert [(r["query_id"], r["samples"]) for r in legacy.event_queries(h, "IO", T0, END).collect()] == [(20202, 6), (10101, 1)]
    assert [tuple(r) for r in legacy.samples_by_database(h, T0, END).collect()] == [("db", 4, 16)]
    assert legacy.wait_timeline(h, T0, END).count() == 9
    assert dict(tuple(r) for r in legacy.activity_summary(h, T0, END).collect())["peak_active_backends"] == "5"
    assert legacy.top_by_type(h, T0, END).count() == 3 and legacy.minute_waits(h, T0, END, 1).count() == 4
    assert [(r["query_id"], r["backend_seconds"]) for r in legacy.hourly_queries(h, T0, END).collect()] == [(20202, 360.0), (30303, 300.0), (10101, 240.0)]
    assert legacy.daily_peak_backends(h, T0, END).first()["peak_backends"] == 5
    assert legacy.top_queries_with_text(h, T0, END).first()["calls"] is None


def test_planner():
    base = floor_to(seconds(datetime(2026, 3, 2, 12)), 60)
    full = SourceStats(raw_oldest=base - 7200, minute_oldest=base - 86400, hour_oldest=base - 864000, minute_watermark=base)
    assert pick_source(full, base - 3600) == "raw" and pick_source(full, base - 80000) == "rollup_1m" and pick_source(full, base - 100000) == "rollup_1h"
    assert pick_source(SourceStats(), base) == "none"
    assert pick_source_agg(full, Window(base - 7200, base), base) == "rollup_1m"
    stale = SourceStats(raw_oldest=base - 7200, minute_oldest=base - 7200, minute_watermark=base - 7140)
    assert pick_source_agg(stale, Window(base - 7200, base), base) == "raw"
    assert Config(num_partitions=6, current_slot=2).active_slots == [2, 1, 0, 5, 4] and sorted(Config().active_slots) == [0, 2]
    for bad in ({"num_partitions": 2}, {"rotation_period": timedelta(hours=12)}, {"num_partitions": 32, "rotation_period": timedelta(days=2)}):
        with pytest.raises(ActivityError):
            Config(**bad)
    assert duration("90 seconds") == 90


def minutes_of(spark, store):
    return sorted(r["ts"] for r in store.rollup("rollup_1m").collect())


def test_late_rows_do_not_touch_what_is_rolled(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "s"), Config(sample_interval=60, rollup_min_backend_seconds=1))
    frame = lambda *rows: spark.createDataFrame(list(rows), stream.SNAPSHOT)
    store.ingest(frame(*[snapshot(k, 1) for k in range(10)]), 0)
    far = 3 * 1440
    with pytest.warns(UserWarning, match="no samples"):
        store.ingest(frame(snapshot(far, 1)), 1)  # days later: the last minutes of the first day are rolled now
    assert minutes_of(spark, store) == [seconds(T0) + 60 * k for k in range(10)]
    before = store.state()
    store.ingest(frame(snapshot(3, 2), snapshot(far, 2)), 2)
    assert store.counters()["late"] == 1 and store.late().count() == 1
    assert minutes_of(spark, store) == [seconds(T0) + 60 * k for k in range(10)] and store.watermark() == before["minute"]
    assert store.observations().count() == 12
    gone = store.retain(seconds(T0) + 4 * 86400)
    assert [g for g in gone if g.startswith("raw/")] == ["raw/2026-03-02"]
    store.ingest(frame(snapshot(4, 2)), 3)
    assert minutes_of(spark, store) == [seconds(T0) + 60 * k for k in range(10)] and store.counters()["late"] == 2
    store.ingest(frame(snapshot(3, 2), snapshot(far, 2)), 2)  # a batch again: the same bounds, the same rows
    assert store.counters()["late"] == 2 and store.observations().count() == 2
    assert store.rollup("rollup_1h").agg(F.sum("samples")).first()[0] == 10


def test_raw_that_is_not_rolled_stays(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "s"), Config(sample_interval=60, rollup_min_backend_seconds=1))
    store.ingest(spark.createDataFrame([snapshot(k, 1) for k in range(5)] + [snapshot(2000, 1)], stream.SNAPSHOT), 0, limit=3)
    assert minutes_of(spark, store) == [seconds(T0) + 60 * k for k in range(3)]
    assert store.catch_up(seconds(T0) + 2000 * 60, limit=10) == 10 and len(minutes_of(spark, store)) == 5
    store._commit(store.state() | {"minute": seconds(T0) + 3000 * 60})  # as if a rollup folder had been lost
    store._write(store.rollup("rollup_1m").filter("ts < 0"), "other", ["day", "batch"])
    import shutil

    shutil.rmtree(tmp_path / "s" / "rollup_1m")
    with pytest.warns(UserWarning, match="not rolled up"):
        assert not [g for g in store.retain(seconds(T0) + 20 * 86400) if g.startswith("raw/2026-03-02")]


def test_compaction_keeps_the_rows(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "s"), Config(sample_interval=60, rollup_min_backend_seconds=1))
    for k in range(3):
        store.ingest(spark.createDataFrame([snapshot(k * 5 + j, 1) for j in range(5)], stream.SNAPSHOT), k)
    store.ingest(spark.createDataFrame([snapshot(3000, 1)], stream.SNAPSHOT), 3)
    with pytest.raises(ActivityError):
        store.compact("raw", "2026-03-02")  # batch 3 may run again
    store.ingest(spark.createDataFrame([snapshot(3001, 1)], stream.SNAPSHOT), 4)
    want = sorted(tuple(r) for r in store.rollup("rollup_1m").drop("batch").collect())
    for name in ("raw", "rollup_1m"):
        store.compact(name, "2026-03-02")
    assert sorted(tuple(r) for r in store.rollup("rollup_1m").drop("batch").collect()) == want and store.observations().count() == 17
    assert len(list((tmp_path / "s" / "rollup_1m" / "day=2026-03-02").glob("batch=*"))) == 1
    plan = store.history(END).minutes_in(seconds(T0), seconds(T0) + 60)._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters")[1][:200]


def test_slots_and_logging():
    from tickfold.model import set_debug_logging, slots_for, slots_from

    c = Config(num_partitions=6, current_slot=2)
    assert slots_for(c) == slots_for(c, "4 days") == [2, 1, 0, 5, 4] and slots_from(c, "2026-03-01", "2026-03-02") == [2, 1, 0, 5, 4]
    for look in ("5 days", -1):
        with pytest.warns(UserWarning):
            assert slots_for(c, look) == []
    assert set_debug_logging(c)[1].endswith("off") and set_debug_logging(c, True)[0].debug_logging


def test_slots_have_their_own_query_ids(spark):
    rows = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (2, 9), (2, 10)], "slot int, query_id long")
    got = codec.register(spark.createDataFrame([], "id int, query_id long, slot int"), rows, ["query_id", "slot"], 2, "slot")
    assert sorted((r["slot"], r["id"], r["query_id"]) for r in got.collect()) == [(1, 1, 7), (1, 2, 8), (2, 1, 8), (2, 2, 9)]
    waits = spark.createDataFrame([(1, "active", "CPU*", "CPU*")], "id int, state string, type string, event string")
    samples = spark.createDataFrame([(T0, "db", [-1, 1, 1])], "sample_ts timestamp_ntz, database string, data array<int>")
    assert [codec.decode_sample(samples, waits, got, s).first()["query_id"] for s in (1, 2)] == [7, 8]
    h = four_minutes(spark)
    few = codec.build_dictionaries(h.rows())[0].filter("id < 3")
    lost = codec.cap_hits(h.rows(), few, codec.build_dictionaries(h.rows())[1].filter("id < 2")).first()
    assert lost["register_wait_cap_hits"] == 1 and lost["lost_sessions"] > 0 and lost["unnamed_sessions"] > 0


def test_sql_calls(spark):
    from tickfold import sql

    h = four_minutes(spark, rolled=True)
    window = f"since => '{T0.isoformat()}', until => '{END.isoformat()}'"
    assert [r[0] for r in sql.query(h, f"SELECT key FROM top('wait_event_type', {window}, n => 2) ORDER BY pct DESC").collect()] == ["IO", "Lock"]
    assert sql.query(h, f"SELECT avg_aas FROM aas({window}, wait_event => 'it''s (none)')").first()[0] == 0
    assert sql.query(h, f"SELECT count(*) FROM periods('{END.isoformat()}') p JOIN status() s ON true WHERE p.period = '1m'").first()[0] > 10
    assert sql.query(h, f"SELECT delta FROM compare('{T0.isoformat()}', '{(T0 + timedelta(minutes=2)).isoformat()}', '{(T0 + timedelta(minutes=2)).isoformat()}', '{END.isoformat()}')").first()[0] == 1.0
    for name in ("chart", "report", "summary"):
        assert sql.query(h, f"SELECT * FROM {name}({window})").count() > 0
    with pytest.raises(ActivityError):
        sql.query(h, "SELECT * FROM top(now())")
