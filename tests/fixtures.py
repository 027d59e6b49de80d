"""Small histories with known answers."""

from datetime import datetime, timedelta

from tickfold.history import History
from tickfold.model import Config
from tickfold.operators.rollup import roll_hours, roll_minutes

T0 = datetime(2026, 3, 2, 11, 10)
SCHEMA = "sample_ts timestamp_ntz, database string, state string, wait_event_type string, wait_event string, query_id long"
CPU, IO, LOCK = ("CPU*", "CPU*"), ("IO", "DataFileRead"), ("Lock", "tuple")


def rows(start, groups, database="db"):
    """groups: (minute, wait, query, how many)."""
    return [(start + timedelta(minutes=m), database, "active", *w, q) for m, w, q, k in groups for _ in range(k)]


def four_minutes(spark, rolled=False):
    """Four minutes, sixteen backends, one a minute."""
    data = rows(T0, [
        (0, CPU, 10101, 1), (0, IO, 10101, 1), (0, IO, 20202, 1),
        (1, CPU, 10101, 1), (1, IO, 20202, 3),
        (2, CPU, 10101, 1), (2, LOCK, 30303, 4),
        (3, CPU, None, 1), (3, IO, 20202, 2), (3, LOCK, 30303, 1),
    ])
    obs = spark.createDataFrame(data, SCHEMA)
    config = Config(sample_interval=60, rollup_min_backend_seconds=1)
    minutes = roll_minutes(obs, config) if rolled else None
    hours = roll_hours(minutes) if rolled else None
    end = T0 + timedelta(minutes=4)
    return History(spark, obs, end, minutes, hours, config, minute_watermark=end if rolled else None)
