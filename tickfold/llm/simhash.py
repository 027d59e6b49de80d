"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` = 2 or fewer differing bits. Every
bit position gets a non-zero vector of three bits, dealt in turn; for each
non-zero vector v a mask keeps the positions whose vector has odd overlap with
v. Any two (at most ``RADIUS``) differing positions are orthogonal to some v, so
that mask keeps neither and the two fingerprints agree under it: each pair in
the radius meets in at least one of the seven tables. The other tables hold 36
or 37 bits each, so chance meetings are few.

A bucket is never expanded to its pairs. Fingerprints that meet some other one
in a bucket are verified through midpoints: two words differ in at most 2 bits
exactly if some word is within 1 bit of both. Each candidate names itself and its
64 neighbours, and a midpoint is named by at most 65 fingerprints, so a bucket
of any size costs 65 rows a member and no group grows beyond 65.

Components: randomised contraction over different fingerprints. Each round gives
every vertex the member of its closed neighbourhood that comes first in a fresh
hash order and contracts; the expected number of vertices falls by a constant
factor a round. Each round is a stored table; nothing is collected. What is left
once at most ``LAST_EDGES`` edges are, one task joins up: rounds of so few cost
jobs and no work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, stored

RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Bytes of a word that tells texts apart; shorter ones are mostly function words.
LONG = 6
#: Members of a bucket that are all compared with each other.
SMALL = 8
#: Edges that one task may join up.
LAST_EDGES = 10_000
#: MinHash bands over shingles, and rows of a band: texts at Jaccard 0.8 miss all bands with probability (1 - 0.8^5)^24 = 7e-5.
BANDS, BAND_ROWS = 24, 5
#: A salt and an odd factor for each MinHash.
MIXERS = np.array([[xxhash.xxh64_intdigest(b"%s%d" % (x, k), SEED) | (x == b"odd") for k in range(BANDS * BAND_ROWS)] for x in (b"salt", b"odd")], "<u8")


def fingerprint(text: bytes, width: int) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()[width - 1 :] or [len(line)]
    ones, digest = np.zeros(64, "i8"), xxhash.xxh64_intdigest
    for at in range(0, len(ends), BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=False)], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row. Null texts count as empty: fingerprint zero."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py() or b"", width) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; see the module's head."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def candidates(fps: DataFrame) -> DataFrame:
    """The different fingerprints that share a bucket of some table with another one."""
    masks = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(covering_masks())]
    dealt = fps.select("fp", F.explode(F.array(*masks)).alias("b")).select("fp", "b.t", "b.key")
    full = stored(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "key"), "simhash-buckets")
    return dealt.join(full, ["t", "key"], "left_semi").select("fp").distinct()


def links(found: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints at most two bits apart: each midpoint links its namers to the least of them."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    named = found.select("fp", F.explode(near).alias("mid"))
    hubs = named.groupBy("mid").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a")).filter(F.size("fps") > 1)
    return hubs.select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()


def joined_up(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of few edges (a, b), in one task."""

    def run(batches):
        parent: dict[int, int] = {}

        def top(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent[top(a)] = top(b)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([top(v) for v in parent], pa.int64())], ["v", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, root long")


def relabelled(label: DataFrame, step: DataFrame) -> DataFrame:
    moved = step.select(F.col("v").alias("root"), F.col("root").alias("next"))
    return stored(label.join(moved, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "cc-label")


def components(edges: DataFrame, last: int = LAST_EDGES) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): equal roots exactly in one component."""
    edges = stored(edges, "cc-edges")
    label, turn = None, 0
    while edges.limit(last + 1).count() > last:
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min(order(F.col("b"))), order(F.first("a"))).getField("v").alias("root"))
        step = stored(step, "cc-step")
        label = step if label is None else relabelled(label, step)
        ends = edges.join(step.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    step = stored(joined_up(edges), "cc-last")
    return step if label is None else relabelled(label, step)


def near_dedup(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included.
    Words are split at ASCII white space after lower-casing A-Z; a text of fewer
    words than ``width`` is one shingle, and one of none has fingerprint zero and
    links like any other. Null ids never name a component unless all of its ids
    are null. Repeated rows are members like any others; other columns are
    ignored; an empty table gives none.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = stored(candidates(classes), "simhash-candidates")
    roots = components(links(found))
    rooted = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


def word_fingerprints(text: bytes, prints: int) -> list[int]:
    """Independent fingerprints for loosely similar texts: of the different words of at least ``LONG`` bytes (of all words, if none is that long)."""
    words = text.lower().split()
    seen = {w for w in words if len(w) >= LONG} or set(words)
    if not seen:
        return [0] * prints
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in seen], "<u8")
    out = []
    for k in range(prints):
        mixed = (h ^ (h >> np.uint64(32))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones = np.zeros(64, "i8")
        for at in range(0, len(h), BLOCK):
            ones += np.unpackbits(mixed[at : at + BLOCK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of the different shingles; a text of fewer words is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))], "u8"))


def minhash_bands(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """For each band the digest of ``rows`` MinHashes of a set of shingle hashes; equal for two sets with probability Jaccard^rows, wherever the texts differ."""
    if not len(hashes):
        return [0] * bands
    salts, odds = MIXERS[:, : bands * rows]
    least = np.full(bands * rows, (1 << 64) - 1, "<u8")
    for at in range(0, len(hashes), 256):
        mixed = hashes[None, at : at + 256] ^ salts[:, None]
        mixed *= odds[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in least.reshape(bands, rows)]


def compared(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, grade) for pairs (a, b) of uids: 2 if the Jaccard similarity of the shingles of their texts is at least ``least``, 1 if it is at least 2 * ``least`` - 1, else 0."""

    def verify(batches):
        known: dict[int, np.ndarray] = {}

        def of(i, text):
            if i not in known:
                if len(known) > 64:
                    known.clear()
                known[i] = shingles(text, width)
            return known[i]

        for b in batches:
            grades = []
            for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                s, t = of(x, b.column(2)[i].as_py()), of(y, b.column(3)[i].as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                whole = len(s) + len(t) - both
                grades.append(2 if both >= least * whole else int(both >= (2 * least - 1 - 1e-9) * whole))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grades, pa.int32())], ["a", "b", "grade"])

    left = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, grade int").distinct()


def ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("uid", "rep").alias("a"), F.greatest("uid", "rep").alias("b")).distinct()


def settled(met: DataFrame, known: DataFrame) -> DataFrame:
    """(bucket, uid) of the members of met (bucket, rep, uid, due) that need no other comparison in their bucket, by the grades of known.

    The distance 1 - Jaccard is a metric. A member within 1 - least of its
    representative can match another one outside that only if the other is within
    twice that distance of the representative (grade 1). Where a bucket has none
    of grade 1 and all ``due`` members of other components have been compared, the
    linked members are settled.
    """
    graded = met.withColumn("a", F.least("uid", "rep")).withColumn("b", F.greatest("uid", "rep")).join(known, ["a", "b"]).select("bucket", "rep", "uid", "grade", "due")
    closed = graded.groupBy("bucket", "rep").agg(F.max((F.col("grade") == 1).cast("int")).alias("near"), F.count(F.lit(1)).alias("seen"), F.max("due").alias("due"))
    closed = closed.filter("near = 0 and seen = due").select("bucket", "rep")
    return graded.filter("grade = 2").join(closed, ["bucket", "rep"], "left_semi").select("bucket", "uid")


def open_texts(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The uids that may still match another text of their buckets, by the pairs (a, b, grade) of representatives a and members b: all of a representative's members that have two components, or, if none is of grade 1 (see ``settled``), those not linked to it that have."""
    rooted = pairs.join(roots.select(F.col("v").alias("b"), "root"), "b", "left").select("a", "b", "grade", F.coalesce("root", "b").alias("root"))
    rooted = stored(rooted, "similar-rooted")
    far = F.when(F.col("grade") == 0, F.col("root"))
    by_rep = rooted.groupBy("a").agg(F.max((F.col("grade") == 1).cast("int")).alias("near"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(far).alias("far_lo"), F.max(far).alias("far_hi"))
    live = stored(by_rep.filter("near = 1 and lo <> hi or near = 0 and far_lo <> far_hi").select("a", "near"), "similar-live")
    return stored(rooted.join(live, "a").filter("near = 1 or grade = 0").select(F.col("b").alias("uid")).distinct(), "similar-open")


def rare_shingles(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(bucket, uid, size, rest): the rarest shingles of each text, as many as any two texts at Jaccard ``least`` or more must have one of in common.

    Such a pair shares at least k = ceil(least * n) of the n shingles of either,
    so in one order of all shingles, by rarity and hash, the first n - k + 1 of
    both have one in common: the first of all that they share. They share none
    before it, so at most ``rest`` of both: that one and those after it (see
    ``enough``). Shingles that stand in no other text come first and meet nothing;
    they are counted and not written. A text without words has one shingle, 0.
    """

    def cut(batches):
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shingles(text, width)
                found = found if len(found) else np.zeros(1, "u8")
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([uid] * n, pa.int64()), pa.array([n] * n, pa.int32()), pa.array(found.view("i8"), pa.int64())], ["uid", "n", "s"])

    found = stored(texts.select("uid", "text").mapInArrow(cut, "uid long, n int, s long").distinct(), "similar-shingles")
    common = stored(found.groupBy("s").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "similar-common")
    held = found.join(common, "s").groupBy("uid", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "s"))).alias("all"))

    first = F.greatest(F.size("all") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int") + 1, F.lit(0))
    dealt = held.select("uid", F.col("n").alias("size"), F.size("all").alias("common"), F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "x"))
    return stored(dealt.select(F.col("x.s").alias("bucket"), "uid", "size", (F.col("common") - F.col("at")).alias("rest")), "similar-rare")


def enough(least: float):
    """Whether two texts (size, rest and rep_size, rep_rest) that first meet in a bucket can have Jaccard ``least``: they then share least / (1 + least) of the sum of their sizes."""
    return F.least("rest", "rep_rest") * F.lit(1 + least) >= (F.col("size") + F.col("rep_size")) * F.lit(least) - F.lit(1e-9)


def joined(roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """roots (v, root) with the components that the edges fresh (a, b) make one; vertices new to roots are added."""
    ends = fresh.join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
    moved = components(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    old = roots.join(moved.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return stored(old.unionByName(moved.join(roots.select("v"), "v", "left_anti").select("v", "root")), "similar-roots")


def open_members(left: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of left (bucket, uid and others) whose bucket holds two components, with root, n and least: n members, least the first of them."""
    rooted = left.join(roots.withColumnRenamed("v", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = stored(rooted, "similar-rooted")
    live = rooted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket", "n", "least")
    return stored(rooted.join(stored(live, "similar-live"), "bucket"), "similar-members")


def similar_groups(docs: DataFrame, prints: int, radius: int, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(v, root): the components of texts that share a bucket and ``least`` of their shingles, texts without a partner left out; and (uid, doc_id).

    A uid is the hash of a row's id and text, so rows that repeat an id are told apart.

    First the members of a bucket are compared with its representative, the least
    uid (a hash of id and text): n - 1 pairs a bucket, and a large group has
    nearly the same representative in all tables, which keeps its different pairs
    few. Texts that this leaves open (see ``open_texts``) are dealt again by their rarest shingles (see
    ``rare_shingles``), which every pair at ``least`` or more of them shares and
    loose groups, such as texts around one common passage or far edits of one
    text, mostly do not. Members of these buckets are compared until none holds
    members of two components: all of a bucket of up to ``SMALL`` with each other,
    of a larger one with about ``SMALL`` representatives, 16 times as many in each
    further round, but for pairs that cannot have ``enough`` in common. So each
    pair that shares a bucket is compared, linked by others, or too far apart by
    the triangle inequality or by what its rarest shingles leave to share.
    """

    def mark(batches):
        for b in batches:
            fps = [word_fingerprints(x.as_py() or b"", prints) for x in b.column(2)]
            bands = [minhash_bands(shingles(x.as_py() or b"", width)) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["uid", "doc_id", "fps", "bands"])

    bounded_batches(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    texts = docs.filter("doc_id is not null").select(row_uid().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"))
    marked = stored(texts.mapInArrow(mark, "uid long, doc_id long, fps array<long>, bands array<long>"), "words-simhash")
    masks = covering_masks(radius)
    covering = [F.xxhash64(F.lit(k * len(masks) + i), F.col("fps")[k].bitwiseAND(F.lit(signed(m)))) for k in range(prints) for i, m in enumerate(masks)]
    banded = [F.xxhash64(F.lit(prints * len(masks) + i), F.col("bands")[i]) for i in range(BANDS)]
    dealt = marked.select("uid", F.explode(F.array(*covering, *banded)).alias("bucket"))
    first = dealt.groupBy("bucket").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stored(first, "similar-buckets")  # stored, so that the join may split a hot bucket
    met = stored(dealt.join(first, "bucket").filter("uid <> rep").select("bucket", "rep", "uid", "n"), "similar-met")
    # The representative is the least uid, so a. Buckets of two members leave nothing to compare.
    pairs = stored(met.groupBy(F.col("rep").alias("a"), F.col("uid").alias("b")).agg(F.max("n").alias("n")), "similar-candidates")
    known = stored(compared(pairs.select("a", "b"), texts, width, least), "similar-known")
    roots = components(known.filter("grade = 2").select("a", "b"))
    again = open_texts(known.join(pairs.filter("n > 2").select("a", "b"), ["a", "b"]), roots)
    members, reach = open_members(rare_shingles(texts.join(again, "uid"), width, least), roots), SMALL
    while not members.isEmpty():
        chosen = (F.pmod(F.xxhash64("uid", F.lit(reach)), F.lit(1 << 20)) * F.col("n") < reach << 20) | (F.col("uid") == F.col("least"))
        reps = members.filter(chosen).select("bucket", F.col("uid").alias("rep"), F.col("root").alias("rep_root"), F.col("size").alias("rep_size"), F.col("rest").alias("rep_rest"), "n")
        own = members.groupBy("bucket", F.col("root").alias("rep_root")).agg(F.count(F.lit(1)).alias("own"))
        reps = stored(reps.join(own, ["bucket", "rep_root"]).withColumn("due", F.col("n") - F.col("own")).drop("n", "own"), "similar-reps")
        met = stored(members.join(reps, "bucket").filter((F.col("root") != F.col("rep_root")) & enough(least)).select("bucket", "rep", "uid", "due"), "similar-met")
        fresh = stored(ordered_pairs(met).join(known, ["a", "b"], "left_anti"), "similar-candidates")
        fresh = stored(compared(fresh, texts, width, least), "similar-known")
        known = known.unionByName(fresh)
        done = settled(met, known).unionByName(reps.select("bucket", F.col("rep").alias("uid")))
        roots = joined(roots, fresh.filter("grade = 2").select("a", "b"))
        members = open_members(members.drop("root", "n", "least").join(done, ["bucket", "uid"], "left_anti"), roots)
        reach *= 16
    return roots, marked.select("uid", "doc_id").distinct()


def row_uid():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")))


def keep_one_each(docs: DataFrame, prints: int = 8, radius: int = 3, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies the one with the smallest id.

    Near copies share ``least`` of their ``width``-word shingles. Candidates share
    one of ``BANDS`` MinHash bands over these shingles, which miss 7 in 100,000
    pairs at 0.8 wherever the texts differ, or meet in a covering table of
    ``prints`` independent word fingerprints that differ in at most ``radius``
    bits. Texts without words are equal to
    each other. Rows with null ids stay; rows that repeat an id are
    members each by its own text (of equal ids the lesser hash stays), rows equal in
    id and text stay or go together.
    """
    roots, names = similar_groups(docs, prints, radius, width, least)
    groups = stored(roots.join(names, F.col("v") == F.col("uid")).select("root", "uid", "doc_id"), "simhash-groups")
    lead = groups.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("stays"))
    gone = stored(groups.join(lead, "root").filter("uid <> stays.uid").select("uid"), "simhash-dropped")
    return docs.join(gone, row_uid() == gone["uid"], "left_anti")


SQL: dict[str, str] = {}
QUERIES = {"op9_simhash": op9_simhash}
