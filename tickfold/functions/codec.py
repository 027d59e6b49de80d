"""The packed form of a sample: for each wait its negated id, the number of backends, then a query id for each.

One fold over the array checks it and takes it apart: the state is what the next
element must be. An array that is wrong anywhere gives nothing at all.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import display

LEAST, MOST = 3, 100_000
ITEM = "array<struct<wait_id:int,map_id:int>>"


def _fold(data: Column) -> Column:
    """(ok, need, wait, found): need is -1 where a marker is due, 0 where a count is, else the ids still due."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("need"), F.lit(0).alias("wait"), F.array().cast(ITEM).alias("found"))

    def step(s, x):
        ids_due = s["need"] > 0
        marker = (s["need"] == -1) & (x < 0)
        count = (s["need"] == 0) & (x > 0)
        ident = ids_due & (x >= 0)
        return F.struct(
            (s["ok"] & F.coalesce(marker | count | ident, F.lit(False))).alias("ok"),
            F.when(marker, F.lit(0)).when(count, x).when(s["need"] == 1, F.lit(-1)).otherwise(s["need"] - 1).cast("int").alias("need"),
            F.when(marker, -x).otherwise(s["wait"]).cast("int").alias("wait"),
            F.when(s["ok"] & ident, F.concat(s["found"], F.array(F.struct(s["wait"].alias("wait_id"), x.cast("int").alias("map_id"))))).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(data, start, step)


def is_valid(data: Column) -> Column:
    """Whether data is a well-formed packed sample; null is not."""
    s = _fold(data)
    return F.coalesce(F.size(data).between(LEAST, MOST) & s["ok"] & (s["need"] == -1), F.lit(False))


def unpack(data: Column) -> Column:
    """array<struct<wait_id, map_id>> with an element for each backend, empty for malformed data. map_id 0 stands for no query."""
    s = _fold(data)
    ok = F.size(data).between(LEAST, MOST) & s["ok"] & (s["need"] == -1)
    return F.when(ok, s["found"]).otherwise(F.array().cast(ITEM))


def encode(observations: DataFrame, waits: DataFrame, queries: DataFrame) -> DataFrame:
    """(sample_ts, database, active_count, data) from observations and the two dictionaries.

    waits: id, state, type, event; queries: id, query_id. Waits stand in id order, their
    query ids in order.
    """
    w = F.broadcast(waits.select(F.col("id").alias("wait_id"), F.col("state").alias("ws"), F.col("type").alias("wt"), F.col("event").alias("we")))
    q = queries.select(F.col("id").alias("map_id"), F.col("query_id").alias("q"))
    rows = observations.join(w, (F.col("state") == F.col("ws")) & (F.col("wait_event_type") == F.col("wt")) & (F.col("wait_event") == F.col("we")))
    rows = rows.join(q, F.col("query_id") == F.col("q"), "left").select("sample_ts", "database", "wait_id", F.coalesce("map_id", F.lit(0)).alias("map_id"))
    groups = rows.groupBy("sample_ts", "database", "wait_id").agg(F.array_sort(F.collect_list("map_id")).alias("ids"))
    part = F.concat(F.array(-F.col("wait_id"), F.size("ids")), F.col("ids"))
    packed = groups.groupBy("sample_ts", "database").agg(F.sum(F.size("ids")).cast("int").alias("active_count"), F.array_sort(F.collect_list(F.struct("wait_id", part.alias("part")))).alias("parts"))
    return packed.select("sample_ts", "database", "active_count", F.flatten(F.transform("parts", lambda p: p["part"])).alias("data"))


#: Entries of the two dictionaries at most: of waits, and, where they are capped, of query ids in one slot.
WAIT_CAP, QUERY_CAP = 32_000, 50_000
SPREAD = 64


def register(known: DataFrame, seen: DataFrame, names: list[str], cap: int | None, slot: str | None = None) -> DataFrame:
    """The dictionary known (id, *names) with new combinations of seen under the next ids, up to cap entries; what is over the cap stays unknown (see cap_hits).

    With slot, one of names, ids and the cap are those of each slot. New
    combinations are cut to the cap in ``SPREAD`` parts before the rest, SPREAD *
    cap rows at most, are numbered together. Without a cap all get an id: each part
    is numbered by itself, after those before it.
    """
    from pyspark.sql import Window

    by = [slot] if slot else []
    order = [n for n in names if n != slot]
    cond = [seen[n].eqNullSafe(known[n]) for n in names]
    fresh = seen.select(*names).distinct().join(known, cond, "left_anti")
    last = known.groupBy(*by).agg(F.max("id").alias("last"))
    spread = fresh.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(SPREAD)))
    ranked = spread.withColumn("k", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)))
    if cap is None:
        sizes = ranked.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))  # SPREAD rows a slot
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")
        parts = sizes.select(*[F.col(c).alias(f"{c}__") for c in (*by, "part")], before.alias("before"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in (*by, "part")]
        placed = ranked.join(F.broadcast(parts), same).select(*names, (F.col("k") + F.col("before")).alias("k"))
    else:
        placed = ranked.filter(F.col("k") <= cap).drop("k", "part")
        placed = placed.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)))
    placed = placed.join(F.broadcast(last), slot, "left") if by else placed.crossJoin(F.broadcast(last))
    number = F.col("k") + F.coalesce("last", F.lit(0))
    placed = placed if cap is None else placed.filter(number <= cap)
    return known.select("id", *names).unionByName(placed.select(number.cast("int").alias("id"), *names))


def slot_of(config, day) -> Column:
    """The slot of the ring that the day of an observation falls into."""
    days = int(config.rotation_period.total_seconds()) // 86_400
    return F.pmod(F.floor(F.datediff(F.to_date(day), F.lit("1970-01-01")) / days), F.lit(config.num_partitions)).cast("int")


def build_dictionaries(observations: DataFrame, slot: str | None = None, capped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(waits, queries) with ids from 1 in the order of their names; with slot, a column of observations, query ids are numbered in each slot.

    Query ids over QUERY_CAP are left out unless capped is false; then all get a number, in no order.
    """
    spark = observations.sparkSession
    waits = register(spark.createDataFrame([], "id int, state string, type string, event string"), observations.select("state", F.col("wait_event_type").alias("type"), F.col("wait_event").alias("event")), ["state", "type", "event"], WAIT_CAP)
    names = ["query_id", slot] if slot else ["query_id"]
    queries = register(spark.createDataFrame([], "id int, query_id long" + (f", {slot} int" if slot else "")), observations.filter("query_id is not null").select(*names), names, QUERY_CAP if capped else None, slot)
    return waits, queries


def cap_hits(observations: DataFrame, waits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: register_wait_cap_hits (waits that the dictionary lacks), lost_sessions (rows of them, which encode leaves out) and unnamed_sessions (rows whose query id it lacks, which encode stores without one)."""
    w = waits.select(F.col("state").alias("ws"), F.col("type").alias("wt"), F.col("event").alias("we"))
    lost = observations.join(F.broadcast(w), (F.col("state") == F.col("ws")) & (F.col("wait_event_type") == F.col("wt")) & (F.col("wait_event") == F.col("we")), "left_anti")
    sums = lost.agg(F.count_distinct("state", "wait_event_type", "wait_event").alias("register_wait_cap_hits"), F.count(F.lit(1)).alias("lost_sessions"))
    on = [c for c in queries.columns if c not in ("id",)]
    unnamed = observations.filter("query_id is not null").join(queries, on, "left_anti").agg(F.count(F.lit(1)).alias("unnamed_sessions"))
    return sums.crossJoin(F.broadcast(unnamed))


def decode_sample(samples: DataFrame, waits: DataFrame, queries: DataFrame, slot: int) -> DataFrame:
    """decode with the query ids of one slot of the ring: the same map_id names other queries in another slot."""
    return decode(samples, waits, queries.filter(F.col("slot") == slot).select("id", "query_id"))


def decode(samples: DataFrame, waits: DataFrame, queries: DataFrame) -> DataFrame:
    """(sample_ts, database, wait_event, query_id, count): a row for each backend of well-formed samples; count is 1.

    Malformed samples give no rows and one warning.
    """
    bad = samples.filter(~is_valid(F.col("data"))).count()
    if bad:
        warnings.warn(f"decode: {bad} malformed samples were skipped", stacklevel=2)
    each = samples.select("sample_ts", "database", F.inline(unpack(F.col("data"))))
    w = F.broadcast(waits.select(F.col("id").alias("wait_id"), display(F.col("type"), F.col("event")).alias("wait_event")))
    q = queries.select(F.col("id").alias("map_id"), "query_id")
    return each.join(w, "wait_id").join(q, "map_id", "left").select("sample_ts", "database", "wait_event", "query_id", F.lit(1).cast("long").alias("count"))


def decode_at(samples: DataFrame, waits: DataFrame, queries: DataFrame, at) -> DataFrame:
    """decode for the samples of one moment."""
    from ..model import literal_time, seconds

    return decode(samples.filter(F.col("sample_ts") == literal_time(seconds(at))), waits, queries)
