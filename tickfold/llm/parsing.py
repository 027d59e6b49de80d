"""Suffix-array dedup with prefix-free parsing.

Every byte is removed that some string of ``LENGTH`` bytes covers which also
starts elsewhere, in the same text or another.

1. Parse. A rolling hash of ``GRAM`` bytes is taken at each byte. The trigger of
   a window of ``LENGTH`` bytes is the least hash among its first ``REACH``
   positions (the leftmost, if equal), so equal windows have their triggers at
   equal places and triggers are at most ``REACH`` apart. Triggers cut the text
   into phrases; a window is the end of one phrase and what follows its trigger.
2. Prune. All windows with one trigger share the ``LENGTH - REACH + 1`` bytes from
   it on. If no other trigger of the corpus is followed by the same bytes, none
   of its windows recurs; the digests of these bytes are counted over the corpus.
3. Corpus order. For the triggers left, phrase end and following bytes go to the
   task that has their digest; of equal contexts a task sends two at most, enough
   to know that they recur. There the suffixes of the phrases (the dictionary) and the
   following bytes (the parse) are each sorted once, with the lengths that
   neighbours have in common. For each number f of bytes taken from the phrase,
   windows are equal exactly if both their f-byte phrase suffixes and their
   LENGTH - f following bytes fall in one run of common length, so the two suffix
   arrays together order all windows and show the repeated ones.
   A digest that more than ``HOT`` contexts share, as around a passage that stands in
   very many different places, is not sorted in one task: its windows are told
   apart one by one, by digests that are summed up in every task first, so that no
   group of them has more rows than there are tasks.
4. Repeated window starts go back to their texts, which are cut.

Texts travel by a digest key over all tasks, once for the contexts and once for
the cut; contexts are bounded (LENGTH + REACH bytes) and their number follows the
repeated part of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, stored

LENGTH = 400
REACH = 200
GRAM = 16
#: Contexts that one round of sorting takes, more only if they share a digest.
SORT_ROWS = 20_000
#: Digests of contexts that a task remembers.
SEEN = 200_000
#: Contexts of one digest that are sorted together, at most.
HOT = 40_000
KEY = ["doc_id", "text_h", "text_n"]


def triggers(data: np.ndarray, length: int = LENGTH, reach: int = REACH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last): for each trigger the first and last start of the windows that it is the trigger of."""
    count = len(data) - length + 1
    if count <= 0:
        none = np.zeros(0, "i8")
        return none, none, none
    h, k = data.astype("u8") + np.uint64(1), 1
    while k < gram:
        h = h[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) + h[k:]
        k *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype="u8")
    k = 1
    while 2 * k <= reach:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < reach:
        least = np.minimum(least[: k - reach], least[reach - k :])
    at = (least[:count] & np.uint64(0xFFFFFFFF)).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:] - 1, [count - 1]])


def common(rows: np.ndarray) -> np.ndarray:
    """For each row of a sorted byte matrix, how many bytes it begins with like the row before; -1 for the first."""
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[-1], same])


def byte_order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable") if not (rows == 0).any() else np.lexsort(rows.T[::-1])


def repeated(group: np.ndarray, left: list[bytes], right: np.ndarray, least: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the numbers f of bytes before the trigger at which a repeated window starts.

    group: digest number of each context, ascending; left: phrase ends; right: length bytes after the
    trigger, filled up with zeros; least: the smallest f; count: how many contexts are equal to it.
    """
    n = len(left)
    most = np.array(list(map(len, left)))
    width = int(most.max(initial=0))
    back = np.zeros((n, width + 1), "u1")
    for i, x in enumerate(left):
        back[i, : len(x)] = np.frombuffer(x, "u1")[::-1]
    tag = np.ascontiguousarray(group.astype(">u4")).view("u1").reshape(n, 4)
    arrays = []
    for rows in (back, right):
        whole = np.concatenate([tag, rows], axis=1)
        order = byte_order(whole)
        arrays.append((order, common(whole[order]) - 4))
    runs = np.empty((2, n), "i8")
    out: list[list[int]] = [[] for _ in range(n)]
    for f in range(width + 1):
        live = (least <= f) & (f <= most)
        if not live.any():
            continue
        for k, need in ((0, f), (1, length - f)):
            order, same = arrays[k]
            runs[k, order] = np.cumsum(same < need)
        who = np.flatnonzero(live)
        name = runs[0, who] * (n + 1) + runs[1, who]
        _, inverse = np.unique(name, return_inverse=True)
        total = np.bincount(inverse, weights=count[who])
        for i in who[total[inverse] > 1].tolist():
            out[i].append(f)
    return [np.array(x, "i4") for x in out]


def parsed(docs: DataFrame, id_col: str, text_col: str, length: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(base, anchors): per row its size and digest; per row the digests that follow its triggers."""
    body = length - reach + 1

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            keys, sha, size = [], [], []
            for x in b.column(1):
                text = x.as_py() or b""
                at = triggers(np.frombuffer(text, "u1"), length, reach)[0].tolist()
                view = memoryview(text)
                size.append(len(text))
                keys.append(np.array([digest(view[a : a + body]) for a in at], "u8").view("i8"))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), b.column(2), b.column(3), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "sha", "text_h", "text_n", "keys"])

    picked = with_key(docs, id_col, text_col)
    return stored(picked.mapInArrow(run, "doc_id long, n_bytes long, sha string, text_h long, text_n int, keys array<long>"), "parse", "zstd")


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (bytes) and what else tells rows apart; rows equal in all of it are copies and get equal results."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_h"), F.octet_length(text).alias("text_n"))


def join_key(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a with b's columns by the row key; null ids match each other."""
    renamed = b.select(*[F.col(c).alias(f"{c}__") for c in KEY], *[c for c in b.columns if c not in KEY])
    cond = F.col("doc_id").eqNullSafe(F.col("doc_id__")) & (F.col("text_h") == F.col("text_h__")) & (F.col("text_n") == F.col("text_n__"))
    return a.join(renamed, cond, how).drop(*[f"{c}__" for c in KEY])


CONTEXT = "doc_id long, text_h long, text_n int, trig int, key long, ctx long, ctx2 long, body binary, lead int, least int"


def contexts(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str, length: int, reach: int) -> DataFrame:
    """Of each trigger that candidates (row key, picked: places of triggers among the row's) name, one row with its context's digest. In a task the first two of equal contexts bring the bytes: whether there is another is all that counts."""
    body = length - reach + 1

    def run(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            out = {n: [] for n in ("row", "trig", "key", "c1", "c2", "body", "lead", "least")}
            if len(seen) > SEEN:
                seen.clear()  # equal contexts then meet later, in the sort
            for r in range(b.num_rows):
                text = b.column(1)[r].as_py()
                at, first, last = triggers(np.frombuffer(text, "u1"), length, reach)
                view = memoryview(text)
                for i in np.unique(np.asarray(b.column(4)[r].values)).tolist():
                    a, s, e = int(at[i]), int(first[i]), int(last[i])
                    whole = view[s : e + length]
                    mark = xxhash.xxh3_128_digest(whole) + bytes([a - s])
                    times = seen[mark] = seen.get(mark, 0) + 1
                    out["row"].append(r)
                    out["trig"].append(a)
                    out["key"].append(xxhash.xxh64_intdigest(view[a : a + body]))
                    c = xxhash.xxh3_128_digest(mark)
                    out["c1"].append(int.from_bytes(c[:8], "little", signed=True))
                    out["c2"].append(int.from_bytes(c[8:], "little", signed=True))
                    out["lead"].append(a - s)
                    out["least"].append(a - e)
                    out["body"].append(bytes(whole) if times <= 2 else None)
            take = pa.array(out["row"], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(out["trig"], pa.int32()), pa.array(np.array(out["key"], "u8").view("i8")), pa.array(out["c1"], pa.int64()), pa.array(out["c2"], pa.int64()), pa.array(out["body"], pa.binary()), pa.array(out["lead"], pa.int32()), pa.array(out["least"], pa.int32())],
                ["doc_id", "text_h", "text_n", "trig", "key", "ctx", "ctx2", "body", "lead", "least"],
            )

    rows = join_key(with_key(docs, id_col, text_col), candidates, "inner").select("doc_id", "text", "text_h", "text_n", "picked")
    return rows.mapInArrow(run, CONTEXT)


STARTS = "ctx long, ctx2 long, starts array<int>"


def ordered(found: DataFrame, length: int, hot: int) -> DataFrame:
    """(ctx, ctx2, starts array<int>): for each context with repeated windows, the f of each."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def sort(table: pa.Table):
            # equal contexts of several tasks become one
            sums: dict[tuple[int, int], list] = {}
            for key, c1, c2, body, lead, least in zip(*(table.column(c).to_pylist() for c in ("key", "ctx", "ctx2", "body", "lead", "least")), strict=True):
                if (got := sums.get((c1, c2))) is None:
                    sums[c1, c2] = [key, body, lead, least, 1]
                else:
                    got[4] += 1
            rows = list(sums.items())
            keys, group = np.unique(np.array([v[0] for _, v in rows], "i8"), return_inverse=True)
            right = np.zeros((len(rows), length), "u1")
            for i, (_, (_, body, lead, _, _)) in enumerate(rows):
                tail = np.frombuffer(body, "u1")[lead : lead + length]
                right[i, : len(tail)] = tail
            starts = repeated(group.reshape(-1), [v[1][: v[2]] for _, v in rows], right, np.array([v[3] for _, v in rows]), np.array([v[4] for _, v in rows]), length)
            keep = [i for i, s in enumerate(starts) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0][0] for i in keep], pa.int64()), pa.array([rows[i][0][1] for i in keep], pa.int64()), pa.array([starts[i] for i in keep], pa.list_(pa.int32()))], ["ctx", "ctx2", "starts"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index("key"))
            ends = size >= SORT_ROWS and held and keys[-1] != held[0].column("key")[0]  # else all that is held may be one digest that goes on
            held.append(b)
            size += b.num_rows
            if ends:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last digest may go on
                yield sort(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
        if size:
            yield sort(pa.Table.from_batches(held))

    bodies = found.filter("body is not null").select("key", "ctx", "ctx2", "body", "lead", "least")
    many = stored(bodies.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "parse-hot")
    if many.isEmpty():
        return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(run, STARTS)
    few = bodies.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(run, STARTS)
    return few.unionByName(counted(stored(bodies.join(many, "key", "left_semi"), "parse-hot-contexts"), length))


def counted(bodies: DataFrame, length: int) -> DataFrame:
    """As ordered, window by window: those whose 128-bit digest occurs in another context or twice."""

    def run(batches):
        for b in batches:
            out = {n: [] for n in ("ctx", "ctx2", "f", "w1", "w2")}
            for c1, c2, body, lead, least in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4, 5)), strict=True):
                view = memoryview(body)
                for f in range(least, lead + 1):
                    w = xxhash.xxh3_128_digest(view[lead - f : lead - f + length])
                    for n, v in zip(out, (c1, c2, f, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "f" else pa.int64()) for n, v in out.items()], list(out))

    times = bodies.groupBy("ctx", "ctx2").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("body").alias("body"), F.first("lead").alias("lead"), F.first("least").alias("least"))
    times = stored(times.select("key", "ctx", "ctx2", "body", "lead", "least", "n"), "parse-hot-times", "zstd")
    each = times.drop("n").mapInArrow(run, "ctx long, ctx2 long, f int, w1 long, w2 long").join(times.select("ctx", "ctx2", "n"), ["ctx", "ctx2"])
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("w1", "w2")
    again = stored(again, "parse-hot-windows")  # stored, so that the join may split what is frequent
    return each.join(again, ["w1", "w2"], "left_semi").groupBy("ctx", "ctx2").agg(F.array_sort(F.collect_list("f")).alias("starts"))


def cut(text: bytes, starts: np.ndarray, length: int) -> tuple[int, int, list[tuple[int, int]], bytes]:
    """(removed bytes, runs, the runs, what is left) once all windows at starts are gone."""
    starts = np.unique(starts)
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    begin = starts[fresh]
    end = starts[np.concatenate([fresh[1:] - 1, [len(starts) - 1]])] + length
    kept, at = [], 0
    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return int((end - begin).sum()), len(begin), list(zip(begin.tolist(), end.tolist(), strict=True)), b"".join(kept)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start,end>> (bytes, end exclusive).

    Texts are UTF-8 bytes, a null text is empty; texts shorter than ``length``
    lose nothing. Windows never cross texts; the runs removed may begin or end
    within a character. Exact copies lose all of their windows, repeated rows
    too. Ids may be null or repeated: rows equal in id and text get equal
    results. Other columns are ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    base = parsed(docs, id_col, text_col, length, reach)
    anchors = base.select(*KEY, F.posexplode("keys").alias("place", "key"))
    shared = stored(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "parse-shared")  # stored, so that the join may split a hot digest
    candidates = anchors.join(shared, "key", "left_semi").groupBy(*KEY).agg(F.collect_set("place").alias("picked"))
    found = stored(contexts(docs, stored(candidates, "parse-candidates"), id_col, text_col, length, reach), "parse-contexts", "zstd")
    windows = stored(ordered(found, length, hot), "parse-windows")
    marked = found.select(*KEY, "trig", "ctx", "ctx2").join(windows, ["ctx", "ctx2"])
    starts = marked.groupBy(*KEY).agg(F.collect_list(F.struct("trig", "starts")).alias("hits"))
    starts = stored(starts, "parse-starts")

    def run(batches):
        for b in batches:
            removed, spans, where, sha = [], [], [], []
            for text, hits in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                at = np.concatenate([h["trig"].as_py() - np.asarray(h["starts"].values) for h in hits.values])
                n, k, runs, rest = cut(text, at, length)
                removed.append(n)
                spans.append(k)
                where.append([{"start": s, "end": e} for s, e in runs])
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.as_py()) for x in b.column(1)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    hit = join_key(with_key(docs, id_col, text_col), starts, "inner").select("doc_id", "text", "hits").mapInArrow(run, schema)
    whole = join_key(base, starts.select(*KEY), "left_anti")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rest = whole.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("spans"))
    return hit.unionByName(rest)


def op1_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read_table(spark, sf_dir, "documents")).drop("spans")


SQL: dict[str, str] = {}
QUERIES = {"op1_parsing": op1_parsing}
