"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only. Stages, each of
which compares full content and not only digests:

1. local: map-side partial aggregation on (digest, whole normalised text, salt);
2. salted: the groups of (digest, text, salt) are merged, so a class that holds
   a third of all rows is spread over ``salts`` groups;
3. global: the winners of the salts, at most ``salts`` rows a class, meet by
   (digest, text).

Rows get their class by (digest, salt) alone: each digest carries the number of
different texts behind it, and only if that is over one does the text itself
take part in the join. Nothing is collected and no group is held in memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, read_table, stored, without

KEYED = "doc_id long, text_h long, norm string, digest string"
SHORT = "doc_id long, text_h long, digest string"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _normaliser(digest, with_text: bool):
    def run(batches):
        for b in batches:
            norm = pc.ascii_lower(pc.fill_null(b.column(2).cast(pa.large_string()), ""))
            raw = norm.cast(pa.large_binary())
            digests = pa.array([digest(memoryview(x.as_buffer())) if len(x.as_buffer() or b"") else digest(b"") for x in raw], pa.string())
            cols, names = [b.column(0), b.column(1), digests], ["doc_id", "text_h", "digest"]
            if with_text:
                cols, names = [b.column(0), b.column(1), norm.cast(pa.string()), digests], ["doc_id", "text_h", "norm", "digest"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest=sha256_hex) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_h (hash of the text as it is).

    Of rows with equal texts the one with the largest id stays. Null texts count
    as empty; empty texts form a class like any other. Null ids rank below all
    ids; if a class has only null ids its keep_id is null and its rows are kept.
    Rows that repeat the id of the row that stays are that same document and are
    marked kept with it. Other columns are ignored; an empty table gives none.
    ``digest`` maps bytes to a string and may collide: texts are compared too.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_h"), F.col(text_col).alias("text"))
    keyed = base.mapInArrow(_normaliser(digest, True), KEYED)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    part = (
        keyed.withColumn("salt", salt)
        .groupBy("digest", "norm", "salt")
        .agg(F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    )
    whole = part.groupBy("digest", "norm").agg(
        F.max("m").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salt_set")
    )
    whole = stored(
        whole.select("digest", "keep_id", "group_size", "salt_set", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("len")),
        "exact-classes",
    )
    texts = whole.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    shared = texts.filter("texts > 1").select("digest")
    single = whole.join(shared, "digest", "left_anti").select("digest", "keep_id", "group_size", F.explode("salt_set").alias("salt"))
    rows = base.mapInArrow(_normaliser(digest, False), SHORT).withColumn("salt", salt)
    out = rows.join(single, ["digest", "salt"]).select("doc_id", "text_h", "keep_id", "group_size", "digest")
    if not shared.isEmpty():
        # A digest with several texts: the text itself decides.
        hit = keyed.join(shared, "digest", "left_semi")
        out = out.unionByName(
            hit.join(
                hit.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                ["digest", "norm"],
            ).select("doc_id", "text_h", "keep_id", "group_size", "digest")
        )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "text_h")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("text_h")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class, also where the row that stays is repeated."""
    found = stored(exact_dedup(docs), "exact")
    gone = found.filter("not kept").select("doc_id", "text_h").distinct()
    again = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    left = without(docs, gone)
    if again.isEmpty():
        return left
    again = stored(again, "exact-repeated")
    hit = left.join(again, left["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    rest = left.join(again, left["doc_id"].eqNullSafe(again["doc_id"]), "left_anti")
    lowered = [F.col("doc_id"), F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)]
    first = hit.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(lowered)]).agg(F.first(F.struct(*[hit[c] for c in hit.columns])).alias("r"))
    return rest.unionByName(first.select("r.*"))


SQL = {
    "op6_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
