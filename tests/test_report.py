"""Report, chart, summary, status and rollups on the four-minute history."""

from datetime import timedelta

import pytest

from tests.fixtures import T0, four_minutes
from tickfold.operators import render, report
from tickfold.operators import rollup as U

END = T0 + timedelta(minutes=4)


@pytest.fixture(scope="module")
def h(spark):
    return four_minutes(spark, rolled=True)


def test_rollups(h):
    got = {r["ts"] % 3600 // 60: r for r in h.minutes.collect()}
    waits = {m: [(p["event"], p["cnt"]) for p in r["wait_counts"]] for m, r in got.items()}
    assert waits[10] == [("DataFileRead", 2), ("CPU*", 1)] and waits[12] == [("tuple", 4), ("CPU*", 1)]
    assert [(p["query_id"], p["cnt"]) for p in got[11]["query_counts"]] == [(20202, 3), (10101, 1)]
    hour = h.hours.first()
    assert (hour["samples"], hour["peak_backends"]) == (4, 5)
    assert [(p["event"], p["cnt"]) for p in hour["wait_counts"]] == [("DataFileRead", 7), ("tuple", 5), ("CPU*", 4)]
    assert [(p["query_id"], p["cnt"]) for p in hour["query_counts"]] == [(20202, 6), (30303, 5), (10101, 4)]
    assert [(i, x) for i, x in enumerate(hour["minute_counts"]) if x is not None] == [(10, 3), (11, 4), (12, 5), (13, 4)] and len(hour["minute_counts"]) == 60


def test_catch_up(h):
    rows, end, grains = U.rollup_minute(h.rows(), h.config, T0, END + timedelta(seconds=30))
    assert grains == 4 and rows.count() == 4
    assert U.rollup_hour(h.minutes, END, T0)[2] == 0
    assert U.cleanup(h.minutes, h.hours, h.config, END)[2] == "cleanup: deleted 0 minute rows, 0 hourly rows"
    with pytest.raises(ValueError, match="roll up first"):
        U.rotate(h.rows(), h.minutes.limit(0), h.config, END + timedelta(days=9))
    kept, config = U.rotate(h.rows(), h.minutes, h.config, END)
    assert kept.count() == 16 and config.current_slot == 1


def test_report(h):
    r = report.report(h, T0, END + timedelta(seconds=59), vcpus=8)
    assert r["aas_avg"] == {"total": 4, "cpu": 1, "io": 1.75, "ipc": 0, "lock": 1.25, "lwlock": 0}
    assert list(r["aas_worst1m"].values()) == [5, 1, 3, 0, 4, 0]
    assert list(r["aas_p99"].values()) == [4.97, 1, 2.97, 0, 3.91, 0]
    assert list(r["aas_p999"].values()) == [5, 1, 3, 0, 3.99, 0]
    assert r["top_events_worst1m"] == {"io": ["DataFileRead(3.0)"], "ipc": [], "lock": ["tuple(4.0)"], "lwlock": []}
    assert r["top_queryids_worst1m"] == {"total": ["30303(4.0)", "10101(1.0)"], "io": ["20202(3.0)"], "ipc": [], "lock": ["30303(4.0)"], "lwlock": []}
    assert set(r["top_queryids_p99"]) == {"total", "io", "lock"}
    assert (r["coverage"]["minutes_expected"], r["coverage"]["minutes_with_data"], r["vcpus"], r["top_queryids_available"]) == (4, 4, 8, True)
    with pytest.warns(UserWarning, match="raw has coverage"):
        assert report.report(four_minutes(h.spark), T0, END) is None


def test_chart(h):
    rows = render.chart(h, T0, END, n=1, width=10).collect()
    legend = "█ IO:DataFileRead  ▓ Lock:tuple  · Other"
    assert [r["chart"] for r in rows] == [legend] + [b.ljust(len(legend)) for b in ("████··", "██████··", "▓▓▓▓▓▓▓▓··", "████▓▓··")]
    assert rows[1]["detail"] == "IO:DataFileRead=2.00 Other=1.00"
    assert render.chart(h, END, END + timedelta(minutes=2)).count() == 0
    assert render.chart(h, T0, END, color=True).collect()[1]["chart"].startswith("\033[38;2;030;100;255m█")


def test_summary_and_status(h):
    s = {r["metric"]: r["value"] for r in render.summary(h, T0, END).collect()}
    assert len(s) == 19 and s["top_wait_1"] == "IO:DataFileRead (avg_aas 1.75, 43.75%)" and s["top_query_1"] == "20202 (avg_aas 1.50, 37.50%)"
    assert render.summary(h, END, END + timedelta(minutes=2)).first()["metric"] == "status"
    t = {r["metric"]: r["value"] for r in render.status(h).collect()}
    assert (t["samples_total"], t["wait_event_map_count"], t["query_map_count"], t["rollup_1m_rows"]) == ("4", "3", "3", "4")
