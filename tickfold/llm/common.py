"""Helpers that the training-data operators share.

Scratch tables live in the folder that the session names in
``spark.checkpoint.dir``; executors and the driver all see it, and a table that
was written there survives the loss of any executor.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import _made, drop_scratch, scratch_dir, scratch_path, stored  # noqa: F401

#: Rows in a batch that goes through Python.
BATCH_ROWS = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of at most ``BATCH_ROWS``: batches are cut by rows and not by bytes, and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def per_process(key, make):
    """What make() gave when it was last called with key in this process; one object is held at a time. Functions reach Python workers by value, so their modules' own variables would be new in each task."""
    import types

    held = sys.modules.setdefault("tickfold_held", types.ModuleType("tickfold_held")).__dict__
    if held.get("key") != key:
        held["value"] = None
        held["key"], held["value"] = key, make()
    return held["value"]


def ascii_lower(col):
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (doc_id, text_h: hash of the text) does not name; null ids match each other."""
    gone = stored(gone, "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_h"]), "left_anti")


def with_class_winner(keyed: DataFrame, keys: list[str], id_col: str = "doc_id", salts: int = 64) -> DataFrame:
    """For each row of ``keyed``, the largest id and the size of its class.

    Rows are grouped by (keys, salt), so one class that holds a third of all rows is
    spread over ``salts`` groups; partial aggregation combines on the map side
    first. The salt winners, at most ``salts`` rows a class, are then combined
    globally, and the join back runs on (keys, salt), so the hot class stays
    spread. Null ids rank below all others. Adds keep_id and group_size.
    """
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "salt").agg(F.max(id_col).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy(*keys).agg(F.max("m").alias("keep_id"), F.sum("n").alias("group_size"))
    fanned = part.select(*keys, "salt").join(whole, keys)
    return salted.join(fanned, [*keys, "salt"]).drop("salt")


def global_rank(df: DataFrame, order: list[str], name: str, descending: bool = False) -> DataFrame:
    """Add rank (0-based, gapless, over all rows) without sorting in one task.

    A range sort deals the rows out by the order columns; the sorted rows are
    written, each with its partition and place in it, and one count per
    partition (a few numbers per task, not per row) gives the offsets. Rows
    equal in all order columns get neighbouring ranks in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    placed = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), name)
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect()
    start, offsets = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):
        offsets.append((r["part"], start))
        start += r["count"]
    table = spark.createDataFrame(offsets or [(0, 0)], "part long, start long")
    return (
        placed.withColumn("part", F.shiftright("place", 33))
        .join(F.broadcast(table), "part")
        .withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start", "place")
    )
