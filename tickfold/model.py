"""Data model: configuration, schemas, time and display rules.

Times are whole seconds since 1970 UTC inside the engine and TIMESTAMP_NTZ (UTC)
in results. Buckets are anchored at ``ANCHOR``, so that the same window always has
the same bucket bounds, whenever it is asked for.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Midnight UTC, 2026-01-01.
ANCHOR = 1_767_225_600
MINUTE, HOUR, DAY = 60, 3600, 86_400
MAX_BUCKETS = 100_000
TOP_QUERIES = 100

OBSERVATIONS = T.StructType(
    [
        T.StructField("sample_ts", T.TimestampNTZType()),
        T.StructField("database", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("wait_event_type", T.StringType()),
        T.StructField("wait_event", T.StringType()),
        T.StructField("query_id", T.LongType()),
    ]
)
PAIRS = "array<struct<state:string,type:string,event:string,cnt:bigint>>"
ROLLUP_1M = f"ts bigint, database string, samples int, peak_backends int, wait_counts {PAIRS}, query_counts array<struct<query_id:bigint,cnt:bigint>>"
ROLLUP_1H = f"{ROLLUP_1M}, minute_counts array<bigint>"

#: Wait classes of the report.
CLASSES = {"cpu": "CPU*", "io": "IO", "ipc": "IPC", "lock": "Lock", "lwlock": "LWLock"}
CLIENT, BACKGROUND = "client backend", ("autovacuum worker", "logical replication worker", "parallel worker", "background worker")


class ActivityError(ValueError):
    """A request that the engine refuses."""


@dataclass(frozen=True)
class Config:
    """Settings of one history; checked when made."""

    sample_interval: float = 1.0
    num_partitions: int = 3
    rotation_period: timedelta = timedelta(days=1)
    rollup_1m_retention_days: int = 30
    rollup_1h_retention_days: int = 1825
    rollup_min_backend_seconds: int = 3
    include_bg_workers: bool = False
    sampling_enabled: bool = True
    rotated_at: int | None = None
    current_slot: int = 0
    color: bool = False
    debug_logging: bool = False
    databases: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 3 <= self.num_partitions <= 32:
            raise ActivityError(f"a ring has 3 to 32 partitions, not {self.num_partitions}")
        days = self.rotation_period / timedelta(days=1)
        if days <= 0 or days != int(days):
            raise ActivityError("rotation_period must be a positive whole number of days")
        if (self.num_partitions - 1) * days > self.rollup_1m_retention_days:
            raise ActivityError("raw retention must not exceed the retention of the minute rollup")
        if self.rollup_1m_retention_days <= 0 or self.rollup_1h_retention_days <= 0:
            raise ActivityError("retention must be positive")

    @property
    def interval(self) -> float:
        return max(self.sample_interval or 1, 0.001)

    @property
    def active_slots(self) -> list[int]:
        """The readable slots of the ring, newest first: all but the one that is next to be emptied."""
        return [(self.current_slot - k) % self.num_partitions for k in range(self.num_partitions - 1)]


def slots_for(config: Config, lookback=None) -> list[int]:
    """The readable slots, newest first, for a look back from now; none, with a warning, if it is negative or longer than raw rows are kept whole."""
    if lookback is not None:
        asked, kept = duration(lookback), (config.num_partitions - 2) * config.rotation_period.total_seconds()
        if asked < 0:
            warnings.warn(f"a look back of {asked:g} s is negative: no slot has it", stacklevel=2)
            return []
        if asked > kept:
            warnings.warn(f"a look back of {asked:g} s is longer than raw rows are kept ({kept:g} s): no slot has it; use more partitions or a longer period", stacklevel=2)
            return []
    return config.active_slots


def slots_from(config: Config, since, as_of) -> list[int]:
    """slots_for, for a window that begins at since; one that begins after as_of has nothing to look back to."""
    return slots_for(config, seconds(as_of) - seconds(since))


def set_debug_logging(config: Config, enabled: bool | None = None) -> tuple[Config, str]:
    """(configuration, what it now says): without enabled, only tells. While it is on, ingestion logs the sessions it samples."""
    if enabled is not None:
        config = replace(config, debug_logging=enabled)
    return config, f"debug_logging is {'on' if config.debug_logging else 'off'}"


def seconds(value) -> int | None:
    """A time (datetime, naive being UTC, ISO text, or seconds) as whole seconds, rounded down."""
    if value is None or isinstance(value, int):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, datetime):
        value = (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp()
    return int(value // 1)


def duration(value) -> float | None:
    """An interval (timedelta, seconds, or text such as '90 seconds') in seconds."""
    if value is None or isinstance(value, (int, float)):
        return value
    if isinstance(value, timedelta):
        return value.total_seconds()
    number, _, unit = value.strip().partition(" ")
    sizes = {"second": 1, "minute": MINUTE, "hour": HOUR, "day": DAY, "week": 7 * DAY}
    try:
        return float(number) * sizes[unit.strip().removesuffix("s")]
    except (KeyError, ValueError):
        raise ActivityError(f"not an interval: {value!r}") from None


def floor_to(t: int, size: int) -> int:
    return ANCHOR + (t - ANCHOR) // size * size


def floor_col(c: Column, size: int) -> Column:
    """Column form of floor_to; pmod keeps times before the anchor right."""
    return c - F.pmod(c - F.lit(ANCHOR), F.lit(size))


def as_seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def as_time(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def literal_time(t: int) -> Column:
    return F.lit(datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")


def r2(c: Column, digits: int = 2) -> Column:
    """Round half away from zero, by way of a decimal, so that the binary form does not decide."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def display(kind: Column, event: Column) -> Column:
    """How a wait is named: the event alone if it is its own type."""
    return F.when(event == kind, event).otherwise(F.concat(kind, F.lit(":"), event))


def synthetic(state: Column, value: Column) -> Column:
    """The wait type or event of a backend: one without a wait is on CPU if active, else idle in a transaction."""
    return F.coalesce(value, F.when(state.like("idle in transaction%"), F.lit("IdleTx")).otherwise(F.lit("CPU*")))
