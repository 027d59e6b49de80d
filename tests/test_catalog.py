"""Registered queries against their SQL on events that go over the caps of what is stored."""

import warnings
from collections import Counter
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.fixtures import CPU, SCHEMA, T0, rows
from tickfold import catalog
from tickfold.history import History
from tickfold.model import Config
from tickfold.operators import legacy
from tickfold.operators.rollup import roll_hours, roll_minutes


def differences(spark, folder, name):
    """Rows that only Spark and rows that only the SQL returns."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    got, want = Counter(tuple(r) for r in df.collect()), Counter(con.execute(f"SELECT {columns} FROM ({catalog.SQL[name]})").fetchall())
    assert want
    return got - want, want - got


@pytest.fixture(scope="module")
def many_ids(tmp_path_factory):
    """57,000 events of one slot, 51,300 of them with a query id of their own; the last ones have the largest ids."""
    folder = str(tmp_path_factory.mktemp("many_ids"))
    duckdb.connect().execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-02' + to_seconds(i // 20) AS ts, i AS user_id, ['click', 'view', 'purchase'][1 + i % 3] AS event_type
FROM (SELECT unnest(range(57000)) AS i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


def test_slots_over_the_cap(spark, many_ids):
    assert differences(spark, many_ids, "decode_sample_slots") == (Counter(), Counter())


def test_moment_over_the_cap(spark, many_ids):
    assert differences(spark, many_ids, "decode_sample_at") == (Counter(), Counter())


def test_round_trip_keeps_its_cap(spark, many_ids):
    assert differences(spark, many_ids, "codec_round_trip") == (Counter(), Counter())


def test_hours_over_the_cap(spark, tmp_path):
    """Two hours, one of them in one minute: 110 queries of each database appear twice in it, and 9000 once in each, which makes it the leading one."""
    duckdb.connect().execute(f"""COPY (SELECT row_number() OVER (ORDER BY h, k, i) * 30 + 1 + k AS event_id, TIMESTAMP '2024-01-02' + to_seconds(h * 3600 + (i % 40) * (1 - h) * 60 + k) AS ts,
       CASE WHEN i = 220 THEN 9000 ELSE k * 1000 + i % 110 END AS user_id, 'view' AS event_type
FROM (SELECT unnest(range(2)) AS h), (SELECT unnest(range(3)) AS k), (SELECT unnest(range(221)) AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    assert differences(spark, str(tmp_path), "legacy_hourly_queries") == (Counter(), Counter())


def test_hours_are_counted_from_what_is_there(spark):
    """As before, in two databases: without its raw rows an hour has only its lists, and says so."""
    later, end = T0 + timedelta(hours=1), T0 + timedelta(hours=2)
    data = [r for start in (T0, later) for db in (0, 1) for r in rows(start, [(i % 30, CPU, db * 1000 + i, 2) for i in range(1, 111)] + [(31, CPU, 9000, 2)], f"db{db}")]
    obs, config = spark.createDataFrame(data, SCHEMA), Config(sample_interval=60, rollup_min_backend_seconds=1)
    minutes = roll_minutes(obs, config)
    hours = roll_hours(minutes)
    lead = lambda raw: [(r["query_id"], r["backend_seconds"]) for r in legacy.hourly_queries(History(spark, raw, end, minutes, hours, config), T0, end, 1).orderBy("hour").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert lead(obs) == [(9000, 240.0)] * 2  # raw begins within the first hour, and so did the history
    with pytest.warns(UserWarning, match="1 hours"):
        assert lead(obs.filter(F.col("sample_ts") >= F.lit(T0 + timedelta(minutes=5)))) == [(1, 120.0), (9000, 240.0)]
    with pytest.warns(UserWarning, match="1 hours"):
        assert lead(obs.filter(F.col("sample_ts") >= F.lit(later))) == [(1, 120.0), (9000, 240.0)]
    with pytest.warns(UserWarning, match="2 hours"):
        assert lead(None) == [(1, 120.0)] * 2
