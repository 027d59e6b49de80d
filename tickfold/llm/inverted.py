"""Benchmark decontamination with a distributed positional inverted index.

Built from DataFrame functions alone. Words are the runs of letters and digits
(every character outside ASCII counts as a letter), A-Z lower-cased.

1. The test side: each item's windows of ``WINDOW`` words (a shorter item is one
   window).
2. The index: postings (document, position, term) of every training token that
   is a term of the test side, stored in document order. Tokens that no test
   item has are never looked up, so they are not kept.
3. Rarest first: the index itself gives the terms' frequencies. Of each window
   the ``SEEDS`` rarest terms are looked up, their postings are shifted by the
   term's place in the item and intersected: a (document, item, shift) survives
   for the windows whose seed terms all put it there.
4. Survivors are compared with the document's words, all of the window.

Terms and seeds are joined by broadcast only below ``BROADCAST_ROWS`` rows, which
is checked; beyond that the joins shuffle. A passage that a third of all documents
share makes many postings but each document's matches stay with the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, read_table, stored, without

WINDOW = 10
SEEDS = 2
BROADCAST_ROWS = 500_000
#: Fixed value: ASCII characters that part words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text, letters as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lowered(word):
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df as a broadcast side if its rows, counted, are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def test_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """no, item (its id as a string) and w (its words) for each item that has words."""
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(ascii_lower(F.col(text_col))).alias("w"))
    return stored(split.filter(F.size("w") > 0).select(F.monotonically_increasing_id().alias("no"), "item", "w"), "bench-items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (uid, pos, term) of the terms in vocabulary (column term). uid is a hash of id and text; should two rows share one, they share candidates, which are compared with the text anyway."""
    tokens = docs.select(uid(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "word"))
    return tokens.select("uid", "pos", lowered(F.col("word")).alias("term")).join(maybe_broadcast(vocabulary), "term").select("uid", "pos", "term")


def uid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid")


def windows(wanted: DataFrame, index: DataFrame, size: int = WINDOW, n: int = SEEDS) -> DataFrame:
    """no, item, begin, terms, offs, seed_terms: each item's windows with the places (in the item) of their n rarest terms. Windows with a term that the corpus lacks are left out."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = wanted.select("no", "item", F.explode(begins).alias("begin"), "w").select("no", "item", "begin", F.slice("w", F.col("begin") + 1, F.lit(size)).alias("terms"))
    places = each.select("no", "begin", F.posexplode("terms").alias("at", "term"))
    rated = places.join(maybe_broadcast(df), "term", "left").select("no", "begin", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", (F.col("begin") + F.col("at")).alias("off")).alias("p"))
    rarest = rated.groupBy("no", "begin").agg(F.slice(F.array_sort(F.collect_list("p")), 1, n).alias("p")).filter(F.col("p")[0]["df"] > 0)
    return each.join(rarest, ["no", "begin"]).select("no", "item", "begin", "terms", F.col("p.off").alias("offs"), F.col("p.term").alias("seed_terms"))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates (uid, found array<struct<start, len, terms, item>>): places where all seed terms of a window agree.

    Postings are shifted by the term's place in its item, so one posting serves
    all of the item's windows that it is a seed of, and are intersected on
    (document, item, shift).
    """
    wanted = test_items(items, text_col="text")
    vocabulary = stored(wanted.select(F.explode("w").alias("term")).distinct(), "bench-terms")
    index = stored(build_index(docs, vocabulary, id_col, text_col), "postings", "zstd")
    wins = stored(windows(wanted, index, size), "bench-windows")
    seed = stored(wins.select("no", F.explode(F.arrays_zip("offs", "seed_terms")).alias("z")).select("no", F.col("z.offs").alias("off"), F.col("z.seed_terms").alias("term")).distinct(), "bench-seeds")
    least = wins.groupBy("no").agg(F.min(F.size("offs")).alias("need"))
    shifted = index.join(maybe_broadcast(seed), "term").select("uid", "no", (F.col("pos") - F.col("off")).alias("shift"), "off")
    agreed = shifted.groupBy("uid", "no", "shift").agg(F.collect_set("off").alias("there")).join(maybe_broadcast(least), "no").filter(F.size("there") >= F.col("need"))
    full = agreed.join(maybe_broadcast(wins), "no").filter((F.size(F.array_except("offs", "there")) == 0) & (F.col("shift") + F.col("begin") >= 0))
    place = F.struct((F.col("shift") + F.col("begin")).alias("start"), F.size("terms").alias("len"), "terms", "item")
    return full.select("uid", place.alias("m")).groupBy("uid").agg(F.collect_set("m").alias("found"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 2, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_h, item, start): windows all of whose words stand within the window's length and ``slop`` words before and after it, in any order, where the window is placed by its rarest term.

    start is where the window would begin by the place of its rarest term, so a
    permuted window whose rarest term moved by more than ``slop`` is not found. Other
    words may stand between. Exact matches are among the results. Nulls, empty
    texts and repeated rows are treated as by decontaminate.
    """
    wanted = test_items(items, text_col="text")
    vocabulary = stored(wanted.select(F.explode("w").alias("term")).distinct(), "bench-terms")
    index = stored(build_index(docs, vocabulary, id_col, text_col), "postings", "zstd")
    wins = stored(windows(wanted, index, size, 1), "bench-windows")
    seed = wins.select("no", "begin", "item", "terms", F.col("seed_terms")[0].alias("term"), (F.col("offs")[0] - F.col("begin")).alias("at"))
    # The rarest term may stand anywhere in the stretch, so each of its places is a candidate for the window.
    places = index.join(maybe_broadcast(seed), "term").select("uid", F.struct((F.col("pos") - F.col("at")).alias("start"), F.col("pos"), "terms", "item").alias("m"))
    found = places.groupBy("uid").agg(F.collect_set("m").alias("found"))
    base = docs.select(uid(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_h"), F.transform(words(F.col(text_col)), lowered).alias("w"))
    first = lambda m: F.greatest(m["start"] - slop, F.lit(0))
    stretch = lambda m: F.slice("w", first(m) + 1, F.greatest(m["start"] + F.size(m["terms"]) + slop - first(m), F.lit(0)))
    near = lambda m: F.size(F.array_except(m["terms"], stretch(m))) == 0
    return base.join(found, "uid").select("doc_id", "text_h", F.explode(F.filter("found", near)).alias("m")).select("doc_id", "text_h", "m.item", "m.start")


def covered(spans):
    """How many places the spans (struct start, len; in any order) cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_h (hash of the text).

    A null or empty text has no words and no hits; an item without words has no
    windows. Null ids are kept; rows equal in id and text get equal results; a
    null item id is named ``null``. An empty table of documents gives none, one
    of items leaves all documents clean. Other columns are ignored.
    """
    base = docs.select(uid(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = matches(docs, items, size, id_col, text_col)
    split = base.join(found, "uid", "left").select("doc_id", F.xxhash64("text").alias("text_h"), words(F.col("text")).alias("raw"), "found")
    same = lambda m: F.transform(F.slice("raw", m["start"] + 1, m["len"]), lowered) == m["terms"]
    held = split.select("doc_id", "text_h", F.size("raw").cast("long").alias("n_words"), F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), same).alias("hits"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda m: m["item"])))
    spans = F.transform("hits", lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len")))
    out = held.select("doc_id", "text_h", "n_words", covered(spans).cast("long").alias("n_hit"), names.alias("names"))
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_h")


def op10_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_h")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any match, with all their columns."""
    return without(docs, decontaminate(docs, items).filter("contaminated").select("doc_id", "text_h").distinct())


SQL = {
    "op10_inverted": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT r, i, grams.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.s = win.s),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
}
QUERIES = {"op10_inverted": op10_inverted}
