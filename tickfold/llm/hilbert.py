"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, each to 2^bits steps; rows are
ordered by their place on the Hilbert curve through that grid, and the order is
cut into runs of equal row counts. Neighbours on the curve are neighbours in
every dimension, so each shard covers a small box of the metadata and files can
be pruned by the ranges of any of the dimensions: ``write_shards`` writes the files,
``shard_ranges`` gives the least and the greatest value of each dimension in each
shard, and ``shards_to_read`` the shards that a filter needs.

A dimension's steps are the quantiles of its values in their own order (texts by
their first bytes), so neighbouring steps hold neighbouring values and each step
about as many rows as any other.

The order is made by one range sort of narrow rows (no texts travel). Rows with
equal curve places are told apart by id, so a place that holds a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, read_table, stored

SHARDS = 24
BITS = 6
OVERHEAD = 8
ORDER = ["curve", "doc_id", "text_crc32", "size"]


def hilbert_index(points: list, bits: int):
    """Place on the Hilbert curve of each point (integer arrays, one a dimension, each under 2^bits), by undoing the curve's rotations and reflections from the top bit down and then Gray decoding."""
    x = [np.array(p, dtype="i8") for p in points]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = ((x[0] ^ x[i]) & low) * ~hit
            x[0] ^= low * hit + swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = x[0] * 0
    q = top
    while q > 1:
        flip ^= (q - 1) * ((x[n - 1] & q) != 0)
        q >>= 1
    out = x[0] * 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def ordinal(types: dict[str, str], column: str) -> Column:
    """A number in the order of the column's values: texts by their first six bytes, times and truth values as numbers; null stays null."""
    kind, c = types[column], F.col(column)
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("date", "timestamp_ntz"):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    return c.cast("double")


def boundaries(docs: DataFrame, dimensions: list[str], bits: int) -> list[list[float]]:
    """For each dimension the different quantiles, 2^bits - 1 at most, that its steps begin at."""
    types = dict(docs.dtypes)
    shares = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    row = docs.agg(*[F.percentile_approx(F.nanvl(ordinal(types, c), F.lit(None)), shares, F.lit(1000)).alias(f"q{i}") for i, c in enumerate(dimensions)]).first()
    return [sorted(set(q or [])) for q in row]


def curve_of(docs: DataFrame, dimensions: list[str], bits: int) -> Column:
    """The place of each row on the curve; a null (or not a number) takes step 0 of its dimension, values the steps from 1 on."""
    types, cuts = dict(docs.dtypes), [np.array(q) for q in boundaries(docs, dimensions, bits)]
    most = (1 << bits) - 1

    @F.pandas_udf("long")
    def place(points: pd.DataFrame) -> pd.Series:
        found = []
        for q, c in zip(cuts, points.columns, strict=True):
            v = points[c].to_numpy(dtype="f8", na_value=np.nan)
            # Few different values are spread over all steps.
            step = 1 + np.searchsorted(q, v, "right") * (most - 1) // max(1, len(q))
            found.append(np.where(np.isnan(v), 0, step))
        return pd.Series(hilbert_index(found, bits))

    return place(F.struct(*[ordinal(types, c).alias(f"d{i}") for i, c in enumerate(dimensions)]))


def placed_rows(docs: DataFrame, dimensions: list[str], bits: int, id_col: str, text_col: str) -> dict[str, Column]:
    """The columns that order the rows."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return {"curve": curve_of(docs, dimensions, bits), "doc_id": F.col(id_col).cast("long"), "text_crc32": F.crc32(text).cast("long"), "size": (F.octet_length(text) + OVERHEAD).cast("long")}


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    The law is ``rows``: shard s holds the ranks with floor(rank * shards / n) =
    s, so counts differ by one at most; slot counts from 0 in each shard. A null
    text has no bytes (size 8, crc 0), a null in a dimension is its lowest step.
    Equal rows, ids included, take neighbouring slots. Null ids come first.
    An empty table gives none; columns not named are ignored.
    """
    narrow = docs.select(*[c.alias(n) for n, c in placed_rows(docs, dimensions, bits, id_col, text_col).items()])
    ranked = global_rank(narrow, ORDER, "hilbert")
    n = max(1, ranked.count())
    placed = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {n} as int)"))
    slot = F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, dimensions: list[str], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs with all their columns under path, one folder a shard (shard=N), sorted along the curve; returns shard_ranges of what was written.

    Shards begin where those of hilbert_shards do. Rows that equal a shard's first
    row in curve, id, text and size go to that shard, as nothing tells them apart.
    """
    placed = stored(hilbert_shards(docs, dimensions, shards, bits, id_col, text_col), "hilbert-placed")
    # One row a shard; a null id comes first, as in the order.
    key = lambda c: F.struct(c("curve").alias("a"), F.coalesce(c("doc_id"), F.lit(-(1 << 63))).alias("b"), c("text_crc32").alias("c"), c("size").alias("d"))
    first = placed.filter("slot = 0 and shard > 0").select("shard", key(F.col).alias("k")).collect()
    own = placed_rows(docs, dimensions, bits, id_col, text_col)
    tagged = docs.withColumn("__k", key(own.__getitem__))
    shard = F.lit(0)
    for r in sorted(first, key=lambda r: r["shard"]):
        least = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abcd", r["k"], strict=True)])
        shard = F.when(F.col("__k") >= least, r["shard"]).otherwise(shard)
    tagged = tagged.withColumn("shard", shard).hint("rebalance", "shard").sortWithinPartitions("shard", "__k").drop("__k")
    tagged.write.partitionBy("shard").parquet(path)
    return shard_ranges(docs.sparkSession.read.parquet(path), dimensions)


def shard_ranges(written: DataFrame, dimensions: list[str]) -> DataFrame:
    """shard, rows, and of each dimension lo_, hi_ and nulls_: one aggregation; a row a shard."""
    each = [f(F.col(c)).alias(f"{n}_{c}") for c in dimensions for n, f in (("lo", F.min), ("hi", F.max), ("nulls", lambda x: F.count_if(x.isNull())))]
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *each)


def shards_to_read(ranges: DataFrame, wanted: dict[str, tuple]) -> list[int]:
    """The shards that may hold a row with lo <= dimension <= hi for every dimension of wanted (either bound may be None); all others can be left unread."""
    cond = F.lit(True)
    for c, (lo, hi) in wanted.items():
        if lo is not None:
            cond = cond & (F.col(f"hi_{c}") >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(f"lo_{c}") <= F.lit(hi))
    return sorted(r["shard"] for r in ranges.filter(cond).select("shard").collect())


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read_table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


SQL: dict[str, str] = {}
QUERIES = {"op7_hilbert": op7_hilbert}
