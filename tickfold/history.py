"""A history of activity: what is retained, with the facts that reads are planned by."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import HOUR, MINUTE, ROLLUP_1H, ROLLUP_1M, Config, as_seconds, floor_to, literal_time, seconds
from .operators.grains import minutes_valid
from .plans.planner import Filters, SourceStats, Window

Scan = Callable[[int | None, int | None], DataFrame]


class History:
    """Observations with optional rollups.

    observations: a DataFrame (model.OBSERVATIONS), or a function (since, until) in
    seconds that returns one, so that bounds can reach the scan; minutes and hours
    likewise. as_of stands for
    the present; nothing here reads a clock. query_texts (query_id, query) and
    query_stats (query_id, calls, total_exec_ms) are optional, as are counters for status.
    """

    def __init__(self, spark: SparkSession, observations: DataFrame | Scan | None, as_of, minutes: DataFrame | Scan | None = None, hours: DataFrame | Scan | None = None, config: Config | None = None, query_texts: DataFrame | None = None, query_stats: DataFrame | None = None, minute_watermark=None, hour_watermark=None, stats: SourceStats | None = None, counters: dict[str, int] | None = None):
        self.spark, self.config, self.as_of = spark, config or Config(), seconds(as_of)
        self._observations = observations
        self.has_minutes, self.has_hours = minutes is not None, hours is not None
        self._minutes = minutes if minutes is not None else spark.createDataFrame([], ROLLUP_1M)
        self._hours = hours if hours is not None else spark.createDataFrame([], ROLLUP_1H)
        self.counters = counters or {}
        self.query_texts, self.query_stats = query_texts, query_stats
        self.minute_watermark, self.hour_watermark = seconds(minute_watermark), seconds(hour_watermark)
        self._stats = stats

    @property
    def interval(self) -> float:
        return self.config.interval

    def rows(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Observations in [start, end)."""
        if self._observations is None:
            return self.spark.createDataFrame([], "sample_ts timestamp_ntz, database string, state string, wait_event_type string, wait_event string, query_id long")
        if callable(self._observations):
            return self._observations(start, end)
        found = self._observations
        if start is not None:
            found = found.filter(F.col("sample_ts") >= literal_time(start))
        if end is not None:
            found = found.filter(F.col("sample_ts") < literal_time(end))
        return found

    @property
    def minutes(self) -> DataFrame:
        """The minute rollup, whole; see minutes_in."""
        return self._minutes(None, None) if callable(self._minutes) else self._minutes

    @property
    def hours(self) -> DataFrame:
        return self._hours(None, None) if callable(self._hours) else self._hours

    def minutes_in(self, start: int, end: int) -> DataFrame:
        """Minutes with start <= ts < end; a stored rollup is asked for these days only."""
        return (self._minutes(start, end) if callable(self._minutes) else self._minutes).filter((F.col("ts") >= start) & (F.col("ts") < end))

    def hours_in(self, start: int, end: int) -> DataFrame:
        return (self._hours(start, end) if callable(self._hours) else self._hours).filter((F.col("ts") >= start) & (F.col("ts") < end))

    def raw(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """As rows, with ts in seconds in place of sample_ts."""
        return self.rows(start, end).withColumn("ts", as_seconds(F.col("sample_ts"))).drop("sample_ts")

    @cached_property
    def stats(self) -> SourceStats:
        """One small aggregate over each source, run once."""
        if self._stats is not None:
            return self._stats
        oldest = lambda df, c: df.agg(F.min(c).alias("m")).first()["m"]
        raw = oldest(self.raw(), "ts") if self._observations is not None else None
        boundary = None
        if self.config.rotated_at is not None:
            boundary = floor_to(int(self.config.rotated_at - (self.config.num_partitions - 2) * self.config.rotation_period.total_seconds()), MINUTE)
        minute = oldest(self.minutes, "ts") if self.has_minutes else None
        return SourceStats(raw, boundary, minute, oldest(self.hours, "ts") if self.has_hours else None, self.minute_watermark)

    def has_flat(self, f: Filters):
        """Whether some hour that touches the window has no valid minute detail."""

        def check(w: Window) -> bool:
            rows = self.hours_in(w.start - HOUR + 1, w.end)
            if f.database is not None:
                rows = rows.filter(F.col("database") == f.database)
            return not rows.filter(~minutes_valid(F.col("minute_counts"), F.col("wait_counts"))).isEmpty()

        return check

    def has_coarser(self, f: Filters):
        """Whether ordinary reading would use a rollup, and one holds something of the window before raw begins."""

        def check(w: Window) -> bool:
            from .plans.planner import pick_source_agg

            if self.stats.raw_oldest is None or pick_source_agg(self.stats, w, self.as_of) not in ("rollup_1m", "rollup_1h"):
                return False
            end = min(w.end, floor_to(self.stats.raw_oldest, MINUTE))
            for rows, size in ((self.minutes_in, MINUTE), (self.hours_in, HOUR)):
                near = rows(w.start - size + 1, end)
                if f.database is not None:
                    near = near.filter(F.col("database") == f.database)
                if not near.isEmpty():
                    return True
            return False

        return check
