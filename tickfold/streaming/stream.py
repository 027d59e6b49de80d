"""Continuous operation: snapshots in, observations and rollups kept up to date.

The watermark is the minute up to which rollups are final. Each micro-batch
appends its observations, moves the watermark to the newest sample less the
lateness, and rolls the minutes it has passed, once, into a folder of its own
under each day; nothing that was rolled before is read or written again. Rows of
minutes behind the watermark are late: they are stored apart and counted, and
change neither raw nor rollups, so that these two agree.

A batch that runs twice (after a failure) finds the bounds of its first run in the
state, deals its rows as before and overwrites its own folders. The state is a new
small file for each step; the newest complete one counts.
"""

from __future__ import annotations

import json
import logging
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..history import History
from ..model import DAY, HOUR, MINUTE, ROLLUP_1H, ROLLUP_1M, ActivityError, Config, as_seconds, as_time, floor_to, literal_time
from ..operators.rollup import roll_hours, roll_minutes, unrolled
from ..sources.activity import split_malformed, take_sample

log = logging.getLogger("tickfold")
#: Batches whose bounds the state remembers, and sessions of a batch that debug logging names.
REMEMBERED, LOGGED = 100, 1000
COUNTERS = ("late", "dead_letters", "missed_ticks", "gap_minutes")
SNAPSHOT = "ts timestamp_ntz, pid int, state string, wait_event_type string, wait_event string, backend_type string, query_id long, database string"


def check_interval(every: str) -> str:
    """Trigger intervals: 1 to 59 seconds, whole minutes up to 59, or whole hours up to 23."""
    m = re.fullmatch(r"(\d+) (second|minute|hour)s?", every.strip())
    if not m or not 1 <= int(m[1]) <= (23 if m[2] == "hour" else 59):
        raise ActivityError(f"not an interval to sample at: {every!r}; use 1-59 seconds, 1-59 minutes or 1-23 hours")
    return every


class Store:
    """Folders of one history: raw, late rows and rollups (by day and batch), dead letters (by batch), and the state.

    Batch numbers are those of one streaming query; a store belongs to one query.
    """

    RAW = "sample_ts timestamp_ntz, database string, state string, wait_event_type string, wait_event string, query_id long"

    def __init__(self, spark: SparkSession, root: str, config: Config):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._place(name)
        return fs.exists(path)

    def _write(self, rows: DataFrame, name: str, keys: list[str]) -> None:
        rows = rows.hint("rebalance", *keys)  # few files a folder; a large day is split
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Rows of the days that [lo, hi) touches: whole folders are pruned."""
        if not self._exists(name):
            return self.spark.createDataFrame([], f"{schema}, day date, batch long")
        rows = self.spark.read.schema(f"{schema}, day date, batch long").parquet(f"{self.root}/{name}")
        if lo is not None:
            rows = rows.filter(F.col("day") >= F.to_date(literal_time(lo)))
        if hi is not None:
            rows = rows.filter(F.col("day") <= F.to_date(literal_time(hi)))
        return rows

    def observations(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        rows = self._read("raw", self.RAW, lo, hi)
        if lo is not None:
            rows = rows.filter(F.col("sample_ts") >= literal_time(lo))
        return rows if hi is None else rows.filter(F.col("sample_ts") < literal_time(hi))

    def late(self) -> DataFrame:
        """Rows that came when their minute was final."""
        return self._read("late", self.RAW)

    def rollup(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Stored rollups; bounds are of ts."""
        size = MINUTE if name == "rollup_1m" else HOUR
        rows = self._read(name, ROLLUP_1M if name == "rollup_1m" else ROLLUP_1H, None if lo is None else lo - size, hi)
        if lo is not None:
            rows = rows.filter(F.col("ts") >= lo)
        return rows if hi is None else rows.filter(F.col("ts") < hi)

    def state(self) -> dict:
        """minute and hour (watermarks, or None), batches (number: its bounds and counters) and past (counters of batches no longer listed)."""
        fs, folder = self._place("state")
        empty = {"minute": None, "hour": None, "batches": {}, "past": dict.fromkeys(COUNTERS, 0)}
        if not fs.exists(folder):
            return empty
        names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/state/{names[-1]}").first()["value"]) if names else empty

    def _commit(self, state: dict) -> None:
        """A new version beside the others, visible at once by its final name; only the two newest stay."""
        fs, folder = self._place("state")
        fs.mkdirs(folder)
        old = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))
        name = f"{int(old[-1][:-5]) + 1 if old else 0:015d}.json"
        passing = self._place(f"state/{name}.passing")[1]
        out = fs.create(passing, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not fs.rename(passing, self._place(f"state/{name}")[1]):
            raise ActivityError(f"the state {name} could not be written")
        for n in old[:-1]:
            fs.delete(self._place(f"state/{n}")[1], False)

    def watermark(self) -> int | None:
        return self.state()["minute"]

    def counters(self) -> dict[str, int]:
        """Over all batches: late rows, dead letters, missed ticks, and minutes without samples that later ones followed."""
        state = self.state()
        return {k: state["past"][k] + sum(b[k] for b in state["batches"].values()) for k in COUNTERS}

    def ingest(self, snapshots: DataFrame, batch: int, lateness: int = MINUTE, limit: int | None = None) -> None:
        """Store one batch and roll what the watermark passes, at most ``limit`` minutes of it (see catch_up)."""
        state = self.state()
        known = state["batches"].get(str(batch))
        before = known["before"] if known else state["minute"]
        snapshots.persist()
        try:
            sound, bad = split_malformed(take_sample(snapshots, self.config))
            late = F.lit(False) if before is None else F.col("sample_ts") < literal_time(before)
            facts = sound.select(late.alias("late"), as_seconds(F.col("sample_ts")).alias("s")).agg(F.count_if("late").alias("late"), F.max(F.when(~F.col("late"), F.col("s"))).alias("newest")).first()
            tagged = sound.withColumns({"day": F.to_date("sample_ts"), "batch": F.lit(batch).cast("long")})
            dead = bad.count()
            if dead:
                self._write(bad.withColumn("batch", F.lit(batch).cast("long")), "dead_letters", ["batch"])
            if facts["late"]:
                log.warning("batch %s: %s rows came after their minute was final", batch, facts["late"])
                self._write(tagged.filter(late), "late", ["day", "batch"])
            if facts["newest"] is not None:
                self._write(tagged.filter(~late), "raw", ["day", "batch"])
            if self.config.debug_logging:
                for r in sound.limit(LOGGED).toLocalIterator():
                    log.info("sampled %s", r)
            target = floor_to(facts["newest"] - lateness, MINUTE) if facts["newest"] is not None else before
            missed = missed_ticks(snapshots, self.config)
        finally:
            snapshots.unpersist()
        self._advance(state, batch, before, known["after"] if known else target, limit, {"late": facts["late"], "dead_letters": dead, "missed_ticks": missed})

    def catch_up(self, target: int, limit: int | None = None) -> int:
        """Roll on to target without new rows, at most ``limit`` minutes; returns how many minutes were passed."""
        state = self.state()
        before = state["minute"]
        batch = min([0, *map(int, state["batches"])]) - 1  # numbers below zero are no stream's
        self._advance(state, batch, before, floor_to(target, MINUTE), limit, {})
        after = self.watermark()
        return 0 if after is None or before is None else (after - before) // MINUTE

    def _advance(self, state: dict, batch: int, before: int | None, target: int | None, limit: int | None, counted: dict) -> None:
        start = before
        if start is None and target is not None:
            oldest = self.observations().agg(F.min("sample_ts").alias("m")).select(as_seconds(F.col("m")).alias("m")).first()["m"]
            start = target if oldest is None else min(target, floor_to(oldest, MINUTE))
        after, gaps = target, 0
        if target is not None:
            after = max(target, start)
            if limit is not None:
                after = min(after, start + limit * MINUTE)
            gaps = self._roll(start, after, batch)
            hour = state["hour"] if state["hour"] is not None else floor_to(start, HOUR)
            known = state["batches"].get(str(batch))
            hour = known["hour"] if known else hour
            self._roll_hours(hour, floor_to(after, HOUR), batch)
            state["minute"] = max(after, state["minute"] or after)
            state["hour"] = max(floor_to(after, HOUR), state["hour"] or hour)
            state["batches"][str(batch)] = dict.fromkeys(COUNTERS, 0) | counted | {"before": before, "after": after, "hour": hour, "gap_minutes": gaps}
        elif counted:
            state["batches"][str(batch)] = dict.fromkeys(COUNTERS, 0) | counted | {"before": before, "after": after, "hour": state["hour"]}
        while len(state["batches"]) > REMEMBERED:
            gone = state["batches"].pop(min(state["batches"], key=int))
            state["past"] = {k: state["past"][k] + gone[k] for k in COUNTERS}
        self._commit(state)

    def _roll(self, start: int, end: int, batch: int) -> int:
        """Minutes in [start, end) of the stored rows; returns how many have none."""
        if end <= start:
            return 0
        minutes = roll_minutes(self.observations(start, end).drop("day", "batch"), self.config)
        self._write(minutes.withColumns({"day": F.to_date(as_time(F.col("ts"))), "batch": F.lit(batch).cast("long")}), "rollup_1m", ["day", "batch"])
        filled = self.rollup("rollup_1m", start, end).agg(F.count_distinct("ts").alias("n")).first()["n"]
        gaps = (end - start) // MINUTE - filled
        if gaps:
            warnings.warn(f"rollup: {gaps} minutes before {end} have no samples though later ones exist", stacklevel=4)
        return gaps

    def _roll_hours(self, start: int, end: int, batch: int) -> None:
        if end > start:
            hours = roll_hours(self.rollup("rollup_1m", start, end).drop("day", "batch"), end)
            self._write(hours.withColumns({"day": F.to_date(as_time(F.col("ts"))), "batch": F.lit(batch).cast("long")}), "rollup_1h", ["day", "batch"])

    def compact(self, name: str, day: str) -> None:
        """Write a day of raw or of a rollup as one batch's folder; the small folders go when it is complete. The day must lie behind the bounds of the newest batch, which may run again."""
        batches = self.state()["batches"]
        mark = batches[max(batches, key=int)]["before"] if batches else None
        if mark is None or self._day_end(day) > mark:
            raise ActivityError(f"{day} is not final yet")
        fs, folder = self._place(f"{name}/day={day}")
        old = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        if len(old) < 2:
            return
        rows = self.spark.read.schema({"raw": self.RAW, "rollup_1m": ROLLUP_1M, "rollup_1h": ROLLUP_1H}[name]).parquet(*[p.toString() for p in old])
        passing = self._place(f"compacting/{name}-{day}")[1]
        rows.sortWithinPartitions("sample_ts" if name == "raw" else "ts").write.mode("overwrite").parquet(passing.toString())
        whole = self._place(f"{name}/day={day}/batch={min(int(p.getName()[6:]) for p in old)}")[1]
        kept = self._place(f"compacting/{name}-{day}-old")[1]
        fs.delete(kept, True)
        if not fs.rename(folder, kept):  # the day as it was stays until the new one stands
            raise ActivityError(f"{day} could not be moved aside")
        fs.mkdirs(folder)
        if not fs.rename(passing, whole):
            fs.delete(folder, True)
            fs.rename(kept, folder)
            raise ActivityError(f"{day} could not be replaced")
        fs.delete(kept, True)

    def history(self, as_of) -> History:
        """What is stored, for the readers; bounds prune day folders of raw and of the rollups."""
        plain = lambda f: lambda lo, hi: f(lo, hi).drop("day", "batch")
        state = self.state()
        return History(
            self.spark, plain(self.observations), as_of, plain(lambda lo, hi: self.rollup("rollup_1m", lo, hi)), plain(lambda lo, hi: self.rollup("rollup_1h", lo, hi)), self.config,
            minute_watermark=state["minute"], hour_watermark=state["hour"], counters=self.counters(),
        )

    def _days(self, name: str) -> list[str]:
        fs, path = self._place(name)
        if not fs.exists(path):
            return []
        return sorted(m[1] for s in fs.listStatus(path) if (m := re.fullmatch(r"day=(\d{4}-\d\d-\d\d)", s.getPath().getName())))

    def retain(self, as_of: int) -> list[str]:
        """Remove day folders that retention has run out for. A raw day goes only when the watermark has passed it and no group of it (minute, database) is missing or short in the minute rollup, unless the rollup's own retention is over. Returns what was removed."""
        gone, mark = [], self.watermark() or 0
        raw_from = as_of - int((self.config.num_partitions - 1) * self.config.rotation_period.total_seconds())
        minutes_from = as_of - self.config.rollup_1m_retention_days * DAY
        keep = {"raw": min(mark, raw_from), "late": raw_from, "rollup_1m": minutes_from, "rollup_1h": as_of - self.config.rollup_1h_retention_days * DAY}
        for name, start in keep.items():
            for day in self._days(name):
                end = self._day_end(day)
                if end > start:
                    continue
                if name == "raw":
                    rows = self.observations(end - DAY, end).filter(F.col("sample_ts") >= literal_time(minutes_from))
                    missing = unrolled(rows, self.rollup("rollup_1m", end - DAY, end)).count()
                    if missing:
                        warnings.warn(f"retain: {missing} groups of raw/{day} are not rolled up; the day stays", stacklevel=2)
                        continue
                fs, path = self._place(f"{name}/day={day}")
                fs.delete(path, True)
                gone.append(f"{name}/{day}")
        return sorted(gone)

    def uninstall(self, confirm: str) -> None:
        """Remove all that is stored. Asks for 'yes'."""
        if confirm != "yes":
            raise ActivityError("uninstall removes the history; confirm with 'yes'")
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        base.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(base, True)

    @staticmethod
    def _day_end(day: str) -> int:
        from datetime import datetime, timezone

        return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()) + DAY


def missed_ticks(snapshots: DataFrame, config: Config) -> int:
    """Ticks of the sample interval between the first and the last snapshot that have none."""
    step = max(1, int(config.interval))
    tick = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step)
    r = snapshots.agg(F.count_distinct(tick).alias("n"), F.min(tick).alias("a"), F.max(tick).alias("b")).first()
    return 0 if r["a"] is None else r["b"] - r["a"] + 1 - r["n"]


def start(source: DataFrame, store: Store, checkpoint: str, every: str | None = None, lateness: int = MINUTE, limit: int | None = None) -> StreamingQuery:
    """Run store.ingest on a stream of snapshots (SNAPSHOT): on an interval, or once over all there is."""
    writer = source.writeStream.foreachBatch(lambda df, k: store.ingest(df, k, lateness, limit)).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=check_interval(every))
    return trigger.start()


def stop(query: StreamingQuery) -> None:
    query.stop()
    query.awaitTermination()


def windowed_minutes(source: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """The stateful form, for dashboards: appearances by minute, database and wait, emitted once the watermark passes."""
    marked = source.withColumn("event_time", F.col("sample_ts").cast("timestamp")).withWatermark("event_time", lateness)
    return marked.groupBy(F.window("event_time", "1 minute").alias("w"), "database", "wait_event_type", "wait_event").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("minute"), "database", "wait_event_type", "wait_event", "cnt")


def describe(query: StreamingQuery) -> str:
    """Progress of the last batch as JSON."""
    return json.dumps(query.lastProgress, default=str)
