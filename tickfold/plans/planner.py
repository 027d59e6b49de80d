"""Planning without Spark: windows, the choice of source and grain, and when to refuse.

The choice of source is part of the answer (every reader discloses it), so it is
made here, from a few facts about what is retained, and not left to an optimizer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..model import DAY, HOUR, MAX_BUCKETS, MINUTE, ActivityError, duration, floor_to, seconds

DIMENSIONS = ("wait_event_type", "wait_event", "query_id", "database")
ORDERS = ("avg", "peak", "p99")


@dataclass(frozen=True)
class Filters:
    wait_event_type: str | None = None
    wait_event: str | None = None
    query_id: int | None = None
    database: str | None = None

    @property
    def wait(self) -> bool:
        return self.wait_event_type is not None or self.wait_event is not None

    def only_database(self) -> Filters:
        return Filters(database=self.database)


@dataclass(frozen=True)
class SourceStats:
    """What is retained, in seconds: the oldest of each source, the ring's logical boundary, and how far minutes are rolled up."""

    raw_oldest: int | None = None
    raw_boundary: int | None = None
    minute_oldest: int | None = None
    hour_oldest: int | None = None
    minute_watermark: int | None = None

    @property
    def raw_start(self) -> int | None:
        """Raw is complete from here on: the ring may have held more than it promises."""
        known = [t for t in (self.raw_oldest, self.raw_boundary) if t is not None]
        return None if self.raw_oldest is None else floor_to(min(known), MINUTE)


@dataclass(frozen=True)
class Window:
    start: int
    end: int

    @property
    def span(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class ReadPlan:
    window: Window
    source: str
    read_source: str
    grain: int
    bucket: int
    extrema: bool

    @property
    def buckets_expected(self) -> int:
        return (floor_to(self.window.end - 1, self.bucket) - floor_to(self.window.start, self.bucket)) // self.bucket + 1


def resolve_window(reader: str, since, until, as_of: int, default: int = HOUR) -> Window:
    """[since, until) floored to minutes. Without since: the hour before until. An empty window is its one minute."""
    since, until = seconds(since), seconds(until)
    if since is None:
        since = (as_of if until is None else until) - (default if until is None else HOUR)
    until = as_of if until is None else until
    if since > until:
        raise ActivityError(f"{reader}: since must be less than or equal to until")
    start, end = floor_to(since, MINUTE), floor_to(until, MINUTE)
    return Window(start, end if end > start else start + MINUTE)


def requested_bucket(bucket) -> float:
    size = duration(bucket)
    if size is None or size < MINUTE:
        raise ActivityError(f"bucket must be at least 1 minute, got {bucket}")
    return size


def auto_bucket(span: int) -> int:
    return MINUTE if span <= 6 * HOUR else HOUR if span <= 7 * DAY else DAY


def pick_source(stats: SourceStats, since: int) -> str:
    """The finest source that reaches back to since, else the one that reaches furthest."""
    since = floor_to(since, MINUTE)
    if stats.raw_oldest is not None and since >= floor_to(stats.raw_oldest, MINUTE):
        return "raw"
    if stats.minute_oldest is not None and since >= stats.minute_oldest:
        return "rollup_1m"
    for name, oldest in (("rollup_1h", stats.hour_oldest), ("rollup_1m", stats.minute_oldest), ("raw", stats.raw_oldest)):
        if oldest is not None:
            return name
    return "none"


def pick_source_agg(stats: SourceStats, window: Window, as_of: int) -> str:
    """Long windows prefer minutes to raw, unless the rollup has not caught up with the window."""
    found = pick_source(stats, window.start)
    if window.span > HOUR and stats.minute_oldest is not None and window.start >= stats.minute_oldest:
        caught_up = stats.minute_watermark is not None and stats.minute_watermark >= min(window.end, floor_to(as_of, MINUTE))
        if found != "raw" or caught_up:
            return "rollup_1m"
    return found


def exact_query_guard(reader: str, stats: SourceStats, window: Window, tie: bool, coarser: bool) -> None:
    """A query filter needs raw rows; refuse if raw does not hold the window although something coarser does, or for a query with a wait."""
    if not (tie or coarser):
        return
    start = floor_to(stats.raw_oldest, MINUTE) if coarser and stats.raw_oldest is not None else stats.raw_start
    if start is None or window.end <= start:
        raise ActivityError(f"{reader}: the window lies entirely outside raw retention; a query filter needs raw samples")
    if window.start < start:
        raise ActivityError(f"{reader}: the window begins before raw retention; narrow it or drop the query filter")


def plan(window: Window, stats: SourceStats, as_of: int, bucket, filters: Filters, *, reader: str, dimension: str | None = None, has_flat=lambda w: False, has_coarser=lambda w: False) -> ReadPlan:
    """Source, grain and bucket of one read.

    has_flat(window): whether an hour in it lacks valid minutes; has_coarser(window):
    whether a rollup holds something of the slice before raw begins.
    """
    asked = requested_bucket(bucket)
    by_query = dimension == "query_id"
    exact = filters.query_id is not None or (by_query and filters.wait)
    if exact:
        tie = (filters.query_id is not None and (filters.wait or dimension in ("wait_event_type", "wait_event"))) or (by_query and filters.wait)
        if dimension == "database":
            tie = filters.query_id is not None and filters.wait
        exact_query_guard(reader, stats, window, tie, has_coarser(window))
        source, grain = "raw", MINUTE
    else:
        source = pick_source_agg(stats, window, as_of)
        grain = HOUR if source == "rollup_1h" else MINUTE
    read = source
    if source == "rollup_1h" and not filters.wait and filters.query_id is None and dimension in (None, "database"):
        read = "rollup_1h_minutes"
        if has_flat(window):
            source, grain = "rollup_1h_flat", HOUR
        else:
            grain = MINUTE
    if grain == HOUR:
        window = replace(window, start=floor_to(window.start, HOUR), end=floor_to(window.end + HOUR - 1, HOUR))
    size = -(-max(-int(-asked // 1), grain) // grain) * grain
    return ReadPlan(window, source, read, grain, size, grain <= asked)


def check_bucket_count(p: ReadPlan) -> None:
    if p.window.span // p.bucket > MAX_BUCKETS:
        raise ActivityError(f"timeline: {p.window.span // p.bucket} buckets exceed the cap of {MAX_BUCKETS}; use a coarser bucket")
