"""Readers on small histories with known answers."""

from datetime import timedelta

import pytest

from tests.fixtures import CPU, IO, SCHEMA, T0, four_minutes, rows
from tickfold.history import History
from tickfold.model import ActivityError, Config
from tickfold.operators import readers as R

END = T0 + timedelta(minutes=4)


def m(k):
    return T0 + timedelta(minutes=k)


@pytest.fixture(scope="module")
def h(spark):
    return four_minutes(spark)


@pytest.fixture(scope="module")
def rolled(spark):
    return four_minutes(spark, rolled=True)


def aas(*a, **k):
    r = R.aas(*a, **k).first()
    return r["avg_aas"], r["peak_aas"], r["p99_aas"], r["backend_seconds"], r["buckets_expected"], r["buckets_with_data"]


def test_aas(h):
    assert aas(h, T0, END) == (4.0, 5.0, 4.97, 960.0, 4, 4)
    assert aas(h, T0, END, wait_event_type="IO") == (1.75, 3.0, 2.97, 420.0, 4, 4)
    assert aas(h, T0, END, wait_event="DataFileRead") == aas(h, T0, END, wait_event="IO:DataFileRead") == (1.75, 3.0, 2.97, 420.0, 4, 4)
    assert aas(h, T0, END, wait_event_type="IPC") == (0.0, 0.0, 0.0, 0.0, 4, 4)
    assert aas(h, m(2), m(3)) == (5.0, 5.0, 5.0, 300.0, 1, 1)
    assert aas(h, m(1), m(1))[0] == 4.0
    assert aas(h, T0, END, bucket="1 hour")[:3] == (4.0, 4.0, 4.0)
    assert aas(h, T0, END, database="none")[:4] == (0.0, 0.0, 0.0, 0.0)


def test_refusals(h):
    with pytest.raises(ActivityError, match="aas: since"):
        R.aas(h, END, T0)
    with pytest.raises(ActivityError, match="at least 1 minute"):
        R.aas(h, T0, END, bucket=59.9)
    with pytest.raises(ActivityError, match="dimension"):
        R.top(h, "user", T0, END)
    with pytest.raises(ActivityError, match="order_by"):
        R.top(h, "database", T0, END, order_by="sum")


def test_timeline(h):
    got = R.timeline(h, T0, END, "1 minute").collect()
    assert [r["avg_aas"] for r in got] == [3, 4, 5, 4] and all(r["data_points"] == 1 for r in got)
    one = R.timeline(h, T0, END, "1 hour").collect()
    assert len(one) == 1 and (one[0]["data_points"], one[0]["avg_aas"], one[0]["peak_aas"], one[0]["p99_aas"]) == (4, 4.0, 5.0, 4.97)
    gap = R.timeline(h, END, m(6), 60).collect()
    assert [(r["data_points"], r["avg_aas"]) for r in gap] == [(0, None), (0, None)]


def top(*a, **k):
    return [(r["key"], r["avg_aas"], r["peak_aas"], r["p99_aas"], r["backend_seconds"], r["pct"]) for r in R.top(*a, **k).collect()]


def test_top(h):
    assert top(h, "wait_event_type", T0, END) == [("IO", 1.75, 3.0, 2.97, 420.0, 43.75), ("Lock", 1.25, 4.0, 3.91, 300.0, 31.25), ("CPU*", 1.0, 1.0, 1.0, 240.0, 25.0)]
    assert top(h, "wait_event_type", T0, END, n=1, order_by="peak")[0][0] == "Lock"
    assert top(h, "database", T0, END) == [("db", 4.0, 5.0, 4.97, 960.0, 100.0)]
    assert top(h, "query_id", T0, END, wait_event="IO:DataFileRead", n=1) == [("20202", 1.5, 3.0, 2.97, 360.0, 85.71)]
    assert top(h, "wait_event", T0, END, wait_event_type="IPC") == []
    assert top(h, "wait_event_type", T0, END, n=0) == []


def test_compare(h):
    r = R.compare(h, T0, m(2), m(2), END).first()
    assert (r["avg_aas_1"], r["avg_aas_2"], r["delta"], r["peak_aas_1"], r["peak_aas_2"], r["p99_aas_1"], r["p99_aas_2"], r["pct_1"]) == (3.5, 4.5, 1.0, 4.0, 5.0, 3.99, 4.99, None)
    got = {r["key"]: (r["avg_aas_1"], r["avg_aas_2"], r["delta"], r["peak_aas_1"], r["peak_aas_2"], r["p99_aas_1"], r["p99_aas_2"], r["pct_1"], r["pct_2"]) for r in R.compare(h, T0, m(2), m(2), END, "wait_event_type").collect()}
    assert got == {
        "CPU*": (1, 1, 0, 1, 1, 1, 1, 28.57, 22.22), "IO": (2.5, 1, -1.5, 3, 2, 2.99, 1.98, 71.43, 22.22),
        "Lock": (None, 2.5, 2.5, None, 4, None, 3.97, None, 55.56),
    }
    assert [r["key"] for r in R.compare(h, T0, m(2), m(2), END, "wait_event_type", n=1).collect()] == ["Lock"]
    with pytest.warns(UserWarning, match="window 2"):
        r = R.compare(h, T0, m(2), m(30), m(31)).first()
    assert r["avg_aas_2"] is None and r["delta"] is None


def test_samples(h):
    assert R.samples(h, T0, END).count() == 16
    r = R.samples(h, T0, END, n=1).first()
    assert (r["sample_time"], r["active_backends"], r["wait_event"], r["query_id"]) == (m(3), 4, "CPU*", None)
    assert R.samples(h, T0, END, query_id=30303).count() == 5
    assert R.samples(h, T0, END, wait_event_type="IPC").count() == 0


def test_periods_choose_sources(rolled):
    got = {r["period"]: (r["source"], r["avg_aas"], r["peak_aas"], r["p99_aas"]) for r in R.periods(rolled, END).collect()}
    assert got["1m"] == ("raw", 4.0, 4.0, 4.0)
    assert got["5m"][1:] == (3.2, 5.0, 4.97)
    assert (got["1h"][1], got["1d"][1], got["1w"][1], got["1mo"][1]) == (0.27, 0.01, 0.0, 0.0)


def test_two_databases(spark):
    q1, q2, q3 = 111111, 222222, 333333
    lock = ("Lock", "tuple")
    calm = [(k, w, q, n) for k in (0, 1, 3, 4) for w, q, n in ((IO, q1, 3), (IO, q2, 2), (IO, q3, 1), (CPU, None, 3))]
    spike = [(2, IO, q1, 6), (2, IO, q2, 4), (2, IO, q3, 2), (2, CPU, None, 3), (2, lock, q1, 6)]
    obs = spark.createDataFrame(rows(T0, calm + spike, "A") + rows(T0, [(2, IO, q1, 3)], "B"), SCHEMA)
    h = History(spark, obs, m(5), config=Config(sample_interval=1))
    assert aas(h, T0, m(5)) == (0.2, 0.4, 0.39, 60.0, 5, 5)
    assert aas(h, T0, m(5), wait_event_type="IO") == (0.13, 0.25, 0.24, 39.0, 5, 5)
    assert [(k, s, p) for k, *_, s, p in top(h, "wait_event_type", T0, m(5))] == [("IO", 39.0, 65.0), ("CPU*", 15.0, 25.0), ("Lock", 6.0, 10.0)]
    assert [(k, s) for k, *_, s, _ in top(h, "query_id", T0, m(5))] == [(str(q1), 27.0), (None, 15.0), (str(q2), 12.0), (str(q3), 6.0)]
    assert [(k, s, p) for k, *_, s, p in top(h, "database", T0, m(5))] == [("A", 57.0, 95.0), ("B", 3.0, 5.0)]
    assert top(h, "query_id", T0, m(5), wait_event="DataFileRead")[0][4:] == (21.0, 53.85)
    with pytest.raises(ActivityError, match="entirely outside raw retention"):
        R.top(h, "query_id", T0 - timedelta(days=2), T0 - timedelta(days=2, minutes=-5), wait_event_type="IO")
