"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models over hashed n-grams are estimated, each n-gram counted once
a document (so that one repetitive text does not speak for all): one of the target,
the documents labelled clean, and one of the raw text, all documents of the corpus,
labelled or not. A document's log weight is the log ratio of its probability under
the target model to that under the raw model. Labels say only what the target is;
low quality of a kind that no label names is found as well, by what the raw text
has and the target lacks.

Adding Gumbel noise to the log weights and taking the k largest keys draws k
documents without replacement in proportion to their weights. k is given, or else
the number of documents that rejection sampling with these ratios would accept,
the sum of min(1, weight).

N-grams whose two rates a G-test (``SIGNIFICANT``) cannot tell apart, or that differ
by less than ``LEAST_RATIO``, count as equally likely: most of the many thousand of
a text are rare, and chance would otherwise outweigh what tells texts apart.

The models are arrays of ``BUCKETS`` counts, whatever the corpus; tasks sum them
locally, the sums are added up by bucket, and only the arrays travel. Labelled
rows are a bounded sample (``MAX_LABELLED`` ids, the least by hash); the raw
model, the weights and the draw cover all documents. The draw ranks
narrow rows by a range sort, so no task holds all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, global_rank, per_process, read_table, stored, without

#: Labelled documents to fit on, at most.
MAX_LABELLED = 30_000
#: Buckets of a table: for words, beginnings and marks, and (apart, since there are far more of them) for pairs. Both are powers of two.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 17, 1 << 16
BUCKETS = 2 * (WORD_BUCKETS + PAIR_BUCKETS)
SEED = 42
SMOOTHING = 0.5
#: What twice the log likelihood ratio of one shared rate and of two must reach; among ``BUCKETS`` n-grams of equal rates one or two do by chance.
SIGNIFICANT = 20.0
#: Documents' worth of raw text that the target model is smoothed with.
STRENGTH = 1.0
#: Log ratios nearer to zero than this count as zero: neighbouring words of one language are far from independent.
LEAST_RATIO = 1.5
#: Lengths, in bytes, of the word beginnings that count as n-grams too, so that new forms of known stems are known.
STEMS = (4, 5, 6)
#: Shares of words equal to the one before from which a text counts as repetitive.
REPEATS = (0.1, 0.3, 0.6)
CACHE_ENTRIES = 200_000
BLOCK_WORDS = 1 << 16
#: ASCII marks and digits part words; marks themselves form a second stream of tokens.
WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
LETTERS = bytes(b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128)


class Numbered(dict):
    """A dictionary that computes what it lacks."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        got = self[key] = self.compute(key)
        return got


class Grams:
    """The n-grams of a text: words, pairs of neighbouring words, marks and their pairs, beginnings of words, and the text's shape. Each is hashed to a bucket of two tables independently; n-grams that share both are rare."""

    def __init__(self):
        self.known = Numbered(self.number)
        self.table, self.used = np.zeros((1 << 16, 1 + len(STEMS)), "u8"), 0

    def number(self, word: bytes) -> int:
        """A new row of the table with the hashes of word and of its beginnings (zero where it has none)."""
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        got, self.used = self.used, self.used + 1
        self.table[got] = [hash_of(word), *(hash_of(b"\3" + word[:n]) if len(word) > n else 0 for n in STEMS)]
        return got

    @staticmethod
    def pairs(h: np.ndarray) -> np.ndarray:
        return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers in either table, repeats included."""
        if self.used > CACHE_ENTRIES:
            self.known.clear()
            self.used = 0
        parts, pairs, n, same = [], [], 0, 0
        split = text.translate(WORDS).split()
        for at in range(0, len(split), BLOCK_WORDS):
            ids = [*map(self.known.__getitem__, split[at : at + BLOCK_WORDS + 1])]  # one word over, for the pair across
            rows = self.table[ids]
            h = rows[:, 0]
            parts.append(rows.ravel())
            pairs.append(self.pairs(h))
            same += int(np.count_nonzero(h[1:] == h[:-1]))
            n += len(split[at : at + BLOCK_WORDS])
        marks = np.array([hash_of(b"\0" + m) for m in text.translate(None, LETTERS).split()], "u8")
        often = sum(same >= share * max(1, n) for share in REPEATS)
        shape = np.array([hash_of(b"\1%d:%d" % (often, min(n.bit_length(), 5))), hash_of(b"\2%d" % n.bit_length())], "u8")
        low, high = zip(places(np.concatenate([*parts, marks, self.pairs(marks), shape]), 0, WORD_BUCKETS), places(np.concatenate([*pairs, shape[:0]]), 2 * WORD_BUCKETS, PAIR_BUCKETS), strict=True)
        return np.concatenate(low), np.concatenate(high)


def places(h: np.ndarray, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashes in the two tables that begin at base."""
    low = np.uint64(size - 1)
    return (h & low).astype("i4") + np.int32(base), ((h >> np.uint64(29)) & low).astype("i4") + np.int32(base + size)


def hash_of(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, SEED)


def histograms(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(kind, bucket, n): in how many texts (kind int, text) each n-gram bucket occurs, summed in each task first; bucket -1 counts the texts."""

    def run(batches):
        grams, sums, docs_of = per_process("grams", Grams), {}, {}
        for b in batches:
            for kind, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if kind not in sums:
                    sums[kind] = np.zeros(buckets, "i8")
                for at in grams.of(x.as_py() or b""):
                    sums[kind][at] += 1  # repeats count once
                docs_of[kind] = docs_of.get(kind, 0) + 1
        for kind, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, kind, "i4")), pa.array([*at, -1], pa.int64()), pa.array([*n[at], docs_of[kind]], pa.int64())], ["kind", "bucket", "n"])

    parts = texts.mapInArrow(run, "kind int, bucket long, n long")
    return parts.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """ratio[BUCKETS]: the log ratio of the target's rate to that of raw text, by n-gram bucket.

    Labels: doc_id, quality, toxic; the target is quality <> 0 and toxic <> 1. Rows
    with a null in any of them are not used, and of several labels of one document
    the worst counts. Without a target all ratios are 0.
    """
    bounded_batches(docs.sparkSession)
    whole = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    clean = (F.col("toxic") != 1) & (F.col("quality") != 0)
    picked = whole.select("doc_id", clean.alias("clean")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).filter("clean")
    marked = docs.select("doc_id", "text").join(F.broadcast(stored(picked, "labels")), "doc_id", "left")
    found = histograms(marked.select(F.when(F.col("clean"), 1).otherwise(0).alias("kind"), "text"))
    wide = found.groupBy("bucket").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("target"), F.sum("n").alias("raw"))
    counts = np.zeros((2, BUCKETS + 1))
    for r in wide.collect():  # ``BUCKETS`` + 1 rows at most, whatever the corpus
        counts[:, r["bucket"]] = r["target"], r["raw"]
    return log_ratios(counts[:, :-1], counts[:, -1])


def log_ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """From the texts with each n-gram and all texts, of the target (first) and of raw text: the log ratios that count."""
    if not texts[0]:
        return np.zeros(counts.shape[1])
    raw = (counts[1] + SMOOTHING) / (texts[1] + 1)
    target = (counts[0] + STRENGTH * raw) / (texts[0] + STRENGTH)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.clip(counts[0] / texts[0], 0, 1)
        one = np.where(seen > 0, seen * np.log(seen / raw), 0)
        other = np.where(seen < 1, (1 - seen) * np.log((1 - seen) / np.clip(1 - raw, 1e-12, 1)), 0)
    ratio = np.log(target / raw)
    return np.where((2 * texts[0] * (one + other) >= SIGNIFICANT) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0.0)


def evidence(ratio: np.ndarray, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The sum of log ratios of the different n-grams given by both their buckets; if these disagree, the one nearer to zero, or zero if their signs differ."""
    hit = live[low] & live[high]
    both = np.unique(np.stack([low[hit], high[hit]]), axis=1)
    a, b = ratio[both[0]], ratio[both[1]]
    return np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0).sum(dtype="f8")


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, noise): the log ratio, and a Gumbel variate that the id and the text decide."""
    table = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(ratio.astype("f4")))

    def run(batches):
        grams, known = per_process("grams", Grams), table.value
        live = known != 0
        for b in batches:
            weight = [float(evidence(known, live, *grams.of(x.as_py() or b""))) for x in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weight, pa.float64())], ["doc_id", "h", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, log_weight double")
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    return rows.withColumn("noise", -F.log(-F.log(unit)))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, h (hash of the text), log_weight, gumbel_key, rank (0 best), kept.

    kept marks the k largest keys; without k, k is the sum of min(1, weight),
    rounded. A null text counts as empty. Null and repeated ids are rows like any
    others; ties in the key go to the larger id, and rows equal in id and text
    share a key and rank side by side. Without clean labels every weight is 1 and
    all rows are kept. An empty table gives none; other columns are ignored.
    """
    scored = stored(score(docs, fit(docs, labels, max_labelled)), "resample-scores")
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") / temperature + F.col("noise")).drop("noise")
    if k is None:
        k = round(scored.agg(F.sum(F.least(F.lit(1.0), F.exp("log_weight"))).alias("k")).first()["k"] or 0)
    ranked = global_rank(keyed, ["gumbel_key", "doc_id", "h"], "resample", descending=True)
    return ranked.withColumn("kept", F.col("rank") < k)


def op8_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents: a sampling operator returns its sample."""
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.filter("kept").select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), "rank", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The drawn rows of docs, with all their columns; rows equal in id and text are drawn or rejected together."""
    return without(docs, resample(docs, labels).filter("not kept").select("doc_id", F.col("h").alias("text_h")).distinct())


SQL: dict[str, str] = {}
QUERIES = {"op8_resample": op8_resample}
