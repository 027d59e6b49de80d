"""Operators on whole collections, against brute force, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from tests.llm import data

from tickfold.llm import exact_dedup, inverted, parsing, resample, simhash
from tickfold.llm.common import global_rank, with_class_winner


def largest(ids):
    known = [i for i in ids if i is not None]
    return max(known) if known else None


# Exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(data.lower(data.raw(t)), []).append(i)
    return Counter((i, largest(groups[k]), len(groups[k]), i == largest(groups[k])) for i, t in rows for k in [data.lower(data.raw(t))])


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda b: str(len(b) % 3)], ids=["sha256", "colliding"])
def test_exact(spark, digest):
    got = exact_dedup.exact_dedup(data.frame(spark), salts=3, digest=digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute_exact(data.texts())
    if digest is exact_dedup.sha256_hex:
        assert {r["text_sha256"] for r in got} == {hashlib.sha256(data.lower(data.raw(t))).hexdigest() for _, t in data.texts()}


def test_keep_one(spark):
    docs = data.frame(spark)
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    want = Counter(data.lower(data.raw(t)) for _, t in data.texts())
    assert Counter(data.lower(data.raw(r["text"])) for r in left.collect()) == Counter(dict.fromkeys(want, 1))
    assert exact_dedup.keep_one(data.empty(spark)).count() == 0


def test_helpers(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 0)], "doc_id long, k int")
    got = with_class_winner(df, ["k"], salts=4).collect()
    assert {(r["k"], r["keep_id"], r["group_size"]) for r in got} == {(0, 48, 26), (1, 49, 25)} and len(got) == 51
    ranked = global_rank(df, ["k", "doc_id"], "t").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(51)) and [r["k"] for r in ranked] == sorted(r["k"] for r in ranked)


def test_scratch_is_removed(spark, tmp_path):
    import os

    from tickfold.llm import common

    kept = common.stored(spark.range(3), "x")
    folder = common._made[-1].removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(folder)
    common.drop_scratch(spark)
    assert not os.path.exists(folder) and common._made == []


# Passages


def brute_passages(rows, length):
    count = Counter(b[i : i + length] for _, t in rows for b in [data.raw(t)] for i in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = data.raw(t)
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length,reach", [(400, 200), (60, 30)])
def test_passages(spark, length, reach):
    got = parsing.dedup_passages(data.frame(spark), length=length, reach=reach)
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_passages(data.texts(), length)
    assert parsing.dedup_passages(data.empty(spark)).count() == 0


def test_hot_passages(spark, monkeypatch):
    """One passage in many surroundings, all its digests above the bound, and rounds of a few rows: as by brute force."""
    monkeypatch.setattr(parsing, "SORT_ROWS", 5)
    passage = data.prose(50, 40)
    rows = [(i, data.prose(60 + i, 5 + i % 3) + " " + passage + " " + data.prose(200 + i // 2, 6)) for i in range(40)] + data.texts()
    for hot in (3, 1000):
        got = Counter(tuple(r)[:5] for r in parsing.dedup_passages(data.frame(spark, rows), length=60, reach=30, hot=hot).collect())
        assert got == brute_passages(rows, 60), hot


def test_triggers_depend_on_the_window_alone():
    b = np.frombuffer((data.prose(9, 200) + "a" * 700).encode(), "u1")
    at, first, last = parsing.triggers(b)
    assert first[0] == 0 and last[-1] == len(b) - parsing.LENGTH and (first[1:] == last[:-1] + 1).all()
    for k in (0, 37, 500):
        for w in range(0, 100, 7):
            window = b[k + w : k + w + parsing.LENGTH]
            own = parsing.triggers(window)[0][0]
            whole = at[np.searchsorted(first, k + w, "right") - 1]
            assert own == whole - (k + w)


def test_order_of_windows():
    """The two suffix arrays find exactly the repeated windows among contexts that share a trigger."""
    r = np.random.default_rng(4)
    left = [r.choice([97, 98], 6).astype("u1").tobytes() for _ in range(60)]
    right = r.choice([97, 98], (60, 12)).astype("u1")
    least, count = r.integers(0, 3, 60), r.integers(1, 3, 60)
    got = parsing.repeated(np.zeros(60, "i8"), left, right, least, count, 12)
    seen = Counter()
    for i in range(60):
        for f in range(least[i], 7):
            seen[left[i][6 - f :], right[i][: 12 - f].tobytes()] += count[i]
    for i in range(60):
        assert got[i].tolist() == [f for f in range(least[i], 7) if seen[left[i][6 - f :], right[i][: 12 - f].tobytes()] > 1]


# SimHash


def brute_fingerprint(t, width=3):
    w = data.lower(data.raw(t)).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_pair_in_the_radius_collides():
    r = np.random.default_rng(5)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            flip = sum(1 << int(b) for b in r.choice(64, radius, replace=False))
            assert any(m & flip == 0 for m in masks)


def test_near(spark):
    rows = data.texts()
    got = Counter(tuple(r) for r in simhash.near_dedup(data.frame(spark)).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    name = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    assert got == Counter((i, f"{fps[k]:016x}", name[label[k]]) for k, (i, _) in enumerate(rows))
    assert simhash.near_dedup(data.empty(spark)).count() == 0


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + i // 2) for i in range(1, 40)] + [(200, 201)]
    for last in (0, 30, simhash.LAST_EDGES):  # by contraction, by both, in one task
        got = simhash.components(spark.createDataFrame(edges, "a long, b long"), last).collect()
        roots = {}
        for r in got:
            roots.setdefault(r["root"], set()).add(r["v"])
        assert sorted(map(sorted, roots.values())) == [list(range(61)), list(range(100, 140)), [200, 201]]


def test_components_joined_to_known_ones(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    roots = simhash.joined(simhash.components(frame([(1, 2), (2, 3), (4, 5), (6, 7)])), frame([(3, 5), (8, 9), (9, 7), (10, 11), (1, 3)]))
    found = {}
    for r in roots.collect():
        found.setdefault(r["root"], []).append(r["v"])
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4, 5], [6, 7, 8, 9], [10, 11]]


def test_rare_shingles_meet(spark):
    base = data.prose(21, 150)
    texts = [data.edited(base, step) for step in (*range(6, 40, 3), *range(40, 150, 3))] + [base, base + " " + data.prose(22, 20), data.prose(23, 3), data.prose(23, 3) + " ", "", " "]
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    rare = simhash.rare_shingles(spark.createDataFrame(rows, "uid long, text binary"), 5, 0.8)
    other = rare.select("bucket", *[rare[c].alias(f"rep_{c}") for c in ("uid", "size", "rest")])
    met = {(r["uid"], r["rep_uid"]) for r in rare.join(other, "bucket").filter("uid < rep_uid").filter(simhash.enough(0.8)).collect()}
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    close = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(close) > 100 and close <= met and len(met) < len(sets) * (len(sets) - 1) // 2


def test_links_are_exact(spark):
    r = np.random.default_rng(6)
    base = [int(x) for x in r.integers(-(1 << 63), (1 << 63) - 1, 6)]
    fps = sorted({simhash.signed((b ^ sum(1 << int(k) for k in r.choice(64, n, replace=False))) & ((1 << 64) - 1)) for b in base for n in (0, 1, 1, 2, 2, 3, 4) for _ in range(4)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {x["fp"] for x in simhash.candidates(df).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert {x for p in near for x in p} <= found
    roots = {x["v"]: x["root"] for x in simhash.components(simhash.links(df)).collect()}
    assert all(roots[a] == roots[b] for a, b in near)
    assert set(roots) == {x for p in near for x in p}


def test_keep_one_each(spark):
    base = data.prose(11, 300)
    rows = [(1, base), (2, data.edited(base, 100)), (3, data.prose(12, 300)), (4, data.edited(base, 8)), (5, None), (6, ""), (7, data.prose(13, 5)), (None, base)]
    docs = data.frame(spark, rows)
    left = simhash.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "5", "7", "None"]
    assert simhash.keep_one_each(data.empty(spark)).count() == 0


def test_keep_one_each_compares_all_that_share_a_bucket(spark):
    # Equal sets of words, so all texts share every bucket; moved stretches decide how similar they are.
    words = [f"shared{i:03d}word" for i in range(200)]

    def moved(starts, size=6):
        w = list(words)
        for at in starts:
            w[at : at + size] = w[at : at + size][::-1]
        return " ".join(w)

    rows = [(1, moved((5, 45, 85, 125))), (2, moved(())), (3, moved((165,))), (4, moved((165, 185), 4))]
    for k in range(24):
        mixed = words[:]
        random.Random(k // 2).shuffle(mixed)
        rows.append((10 + k, " ".join(mixed[: 4 * k] + mixed[4 * k : 4 * k + 6 * (k % 2)][::-1] + mixed[4 * k + 6 * (k % 2) :])))
    sets = {i: set(simhash.shingles(t.encode(), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    want = {i for i in root if root[i] == i}
    assert 1 in want and 2 in want and 3 not in want and 4 not in want and len(want) == 14  # 1 shares buckets with 2 and 3, yet neither is its copy
    got = simhash.keep_one_each(data.frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == want


def test_rows_that_repeat_an_id(spark):
    """Of one id with several texts only the near copy goes."""
    base = data.prose(31, 300)
    rows = [(1, base), (2, data.edited(base, 100)), (2, data.prose(32, 200)), (3, data.prose(33, 200)), (3, data.prose(33, 200))]
    left = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one_each(data.frame(spark, rows)).collect())
    assert left == Counter({(1, base): 1, (2, data.prose(32, 200)): 1, (3, data.prose(33, 200)): 2})


def test_near_copies_are_found_wherever_they_differ(spark):
    rows = []
    for k in range(60):
        words = [f"word{k}x{i}longer" for i in range(200)]
        fresh = [f"fresh{k}x{i}longer" for i in range(46)]
        other = [words + fresh, words[:-38], words[:80] + fresh[:17] + words[97:]][k % 3]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        s, t = (set(simhash.shingles(x.encode(), 5).tolist()) for _, x in rows[-2:])
        assert 0.8 <= len(s & t) / len(s | t) < 0.83
    left = {r["doc_id"] for r in simhash.keep_one_each(data.frame(spark, rows)).collect()}
    assert left == {2 * k for k in range(60)}


# Decontamination


def tokens(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(data.raw(t)))


def brute_leaks(rows, items, size=10):
    out = Counter()
    for i, t in rows:
        w, hit, names = tokens(t), set(), set()
        for item, text in items:
            v = tokens(text)
            n = min(size, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1 if wins else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names.add(str(item) if item is not None else "null")
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "c", "c") for i, t in items], "item_id long, text string, term string, no string")


def test_leaks(spark):
    shared = data.prose(3, 90).split(" ")
    items = [(1, " ".join(shared[10:40])), (2, " ".join(shared[20:25])), (10, "one"), (3, "not anywhere at all really"), (4, None), (5, ""), (None, "two words"), (6, "ärger " * 12), (7, " ".join(shared[12:30]).upper()), (7, "--- !!!")]
    got = inverted.decontaminate(data.frame(spark), item_frame(spark, items)).drop("text_h")
    assert Counter(tuple(r) for r in got.collect()) == brute_leaks(data.texts(), items)
    none = inverted.decontaminate(data.frame(spark), item_frame(spark, []))
    assert none.filter("contaminated").count() == 0 and none.count() == len(data.texts())
    assert inverted.decontaminate(data.empty(spark), item_frame(spark, items)).count() == 0
    left = inverted.keep_clean(data.frame(spark), item_frame(spark, items[:2]))
    assert {12, 13, 14}.isdisjoint({r["doc_id"] for r in left.collect()}) and left.count() == len(data.texts()) - 3


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon"
    rows = [(1, "x alpha beta gamma delta epsilon y"), (2, "alpha gamma beta delta one epsilon"), (3, "alpha beta gamma delta"), (4, "alpha beta x x x x gamma delta epsilon"), (5, None), (6, "epsilon delta gamma beta alpha")]
    got = {r["doc_id"] for r in inverted.proximity_matches(data.frame(spark, rows), item_frame(spark, [(1, item)]), slop=1).collect()}
    assert got == {1, 2}
    wide = {r["doc_id"] for r in inverted.proximity_matches(data.frame(spark, rows), item_frame(spark, [(1, item)]), slop=4).collect()}
    assert wide == {1, 2, 4, 6}
    assert inverted.proximity_matches(data.empty(spark), item_frame(spark, [(1, item)])).count() == 0


# Resampling


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        text, kind = data.prose(100 + i, 60), i % 6
        if kind == 0:
            text = " ".join(w + ("!!" if k % 2 else "***") for k, w in enumerate(text.split(" ")))
        if kind == 1:
            text = data.edited(text, 12).replace("edited0x", "nastyword")
        rows.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1), "c"))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, kind string")


def test_resample_held_out(spark):
    rows, labels = labelled(spark)
    docs = data.frame(spark, rows)
    got = {r["doc_id"]: r for r in resample.resample(docs, labels.filter("doc_id < 160")).collect()}
    held = [i for i in range(160, 240)]
    assert all(not got[i]["kept"] for i in held if i % 6 in (0, 1)) and all(got[i]["kept"] for i in held if i % 6 > 1)
    ten = resample.resample(docs, labels, k=10).filter("kept").collect()
    assert len(ten) == 10 and sorted(r["rank"] for r in ten) == list(range(10))


def test_resample_edges(spark):
    docs = data.frame(spark)
    none = spark.createDataFrame([(None, 1, 0, "c"), (3, None, 0, "c"), (4, 1, None, "c")], "doc_id long, quality int, toxic int, kind string")
    got = resample.resample(docs, none).collect()
    assert len(got) == len(data.texts()) and all(r["kept"] for r in got)
    assert [(r["doc_id"], r["gumbel_key"]) for r in resample.resample(docs, none).orderBy("rank").collect()] == [(r["doc_id"], r["gumbel_key"]) for r in sorted(got, key=lambda r: r["rank"])]
    left = resample.keep_good(docs, none)
    assert left.columns == docs.columns and left.count() == len(data.texts())
    assert resample.resample(data.empty(spark), none).count() == 0


def test_log_weights_by_hand(spark):
    """The log weight of every document, recomputed text by text from the rates of its n-grams among the target and among all."""
    rows, labels = labelled(spark, 150)
    rows += [(500, None), (501, ""), (502, rows[0][1] * 30)]
    got = {r["doc_id"]: r["log_weight"] for r in resample.resample(data.frame(spark, rows), labels.filter("doc_id < 120")).collect()}
    grams = resample.Grams()
    each = {i: {*map(tuple, np.stack(grams.of(data.raw(t))).T.tolist())} for i, t in rows}
    target = [i for i in range(120) if i % 6 > 1]
    having = {}
    for i, pairs in each.items():
        for b in {b for pair in pairs for b in pair}:
            having.setdefault(b, set()).add(i)

    def ratio(b):
        n, all_, raw = len(target), len(rows), (len(having[b]) + 0.5) / (len(rows) + 1)
        seen = len(having[b] & set(target)) / n
        g = 2 * n * sum(p * math.log(p / q) for p, q in ((seen, raw), (1 - seen, 1 - raw)) if p > 0)
        r = math.log((seen * n + raw) / (n + 1) / raw)
        return r if g >= resample.SIGNIFICANT and abs(r) >= resample.LEAST_RATIO and all_ else 0.0

    for i, pairs in each.items():
        want = 0.0
        for a, b in pairs:
            x, y = ratio(a), ratio(b)
            want += min(x, y, key=abs) if x * y > 0 else 0.0
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), i
    assert min(got.values()) < -10 and got[500] == got[501]


def test_raw_text_that_no_label_shows(spark):
    """Low quality of a kind without labels: the raw model has it, the target does not."""
    rows = [(i, data.prose(i, 60) + (" spam offer click" * 5 if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400) if i % 4], "doc_id long, quality int, toxic int")
    got = resample.resample(data.frame(spark, rows), labels.filter("doc_id < 200")).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)


def test_gumbel_draw_follows_the_weights(spark):
    """Among texts of equal weight the draw is even; the noise has the standard Gumbel mean."""
    docs = data.frame(spark, [(i, "same words here") for i in range(4000)])
    rows = resample.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), temperature=1.0, k=1000).collect()
    noise = np.array([r["gumbel_key"] - r["log_weight"] for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(np.mean([r["doc_id"] for r in rows if r["kept"]]) - 2000) < 120


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(spark, 120)
    passage = " ".join(data.prose(77, 40).split(" "))
    rows += [(900, rows[8][1].upper()), (901, data.edited(rows[9][1] + " " + data.prose(5, 300), 150)), (902, rows[9][1] + " " + data.prose(5, 300)), (903, data.prose(6, 30) + " " + passage)]
    data.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item_frame(spark, [(1, passage)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(120) if i % 6 > 1}
    assert got == clean - {8} | {900, 901}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == data.frame(spark, rows[:1]).columns, name
