"""Operators on single texts: BPE, secrets, WARC, Hilbert shards, preference segments."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm import data

from tickfold.llm import automaton, bpe, hilbert, preference, secrets, warc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# BPE

ALPHABET = list("aAbZ '’sΣσςé́İ\x1c\x1f\x85\xa0　\n\t0١½Ⅷ_-!<|>你🙂ǅ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE"]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    codec, library = bpe.BpeCodec(open(path, "rb").read()), Tokenizer.from_file(path)
    r = random.Random(1)
    cases = [t for _, t in data.texts() if t] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["-" * 3000, "ab" * 3000]
    for t in cases:
        want = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t[:80])
        assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_forced_cuts():
    codec = bpe.BpeCodec(open(bpe.vocabulary_path(), "rb").read())
    letters = bpe.byte_alphabet()
    inside = {t.removesuffix(bpe.END)[i : i + 2] for t in codec.ids for i in range(len(t.removesuffix(bpe.END)) - 1)}
    for w in ("hello", "qzxj", "strengthszx", "漢字🙂é"):
        raw = w.encode()
        parts = codec.cuts(raw)
        assert b"".join(parts) == raw
        cuts = {sum(map(len, parts[:k])) for k in range(1, len(parts))}
        assert cuts == {i for i in range(1, len(raw)) if letters[raw[i - 1]] + letters[raw[i]] not in inside}


def test_bpe_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = Counter(tuple(r) for r in bpe.bpe_digests(data.frame(spark), bpe.vocabulary_path()).collect())
    want = Counter()
    for i, t in data.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.bpe_digests(data.empty(spark), bpe.vocabulary_path()).count() == 0
    assert bpe.bpe_encode(data.frame(spark, [(1, "hello")]), bpe.vocabulary_path()).first()["decoded"] == "hello</w>"


# Secrets

BASE = [
    ("assign", re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute_secrets(t: bytes):
    found = [(m.start(), m.end(), k) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t) if ok(m)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_scanner():
    scanner = secrets.Scanner()
    r = random.Random(2)
    bits = ["token", "password", "secret", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "abcdef0123456789", "é", "\n", "xyz", "deadbeef", "0", ".", "-", "ghp_", "eyJ"]
    cases = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))).encode() for _ in range(1500)] + [b"a" * 5000, b"", b"token=" * 2000]
    got = scanner.scan(cases)
    for i, t in enumerate(cases):
        assert [s for s in got.get(i, []) if s[2] < 3] == brute_secrets(t), t[:200]


#: Each added kind as a plain expression: head, body and the least length of the body.
ADDED = (r"gh[pousr]_([A-Za-z0-9]+)", 36), (r"xox[abprs]-([A-Za-z0-9-]+)", 10), (r"AIza([A-Za-z0-9_-]+)", 35), (r"eyJ([A-Za-z0-9_.-]+)", 40)


def test_added_kinds():
    """Positive matches of each added kind, against one search for each, among pieces that begin, end and overlap them."""
    scanner, r = secrets.Scanner(), random.Random(9)
    long = lambda n: "".join(r.choice("ABCxyz0189") for _ in range(n))
    seen = Counter()
    for _ in range(800):
        whole = [f"ghp_{long(36)}", f"gho_{long(35)}", f"xoxb-{long(4)}-{long(6)}", f"xoxp-{long(9)}", f"AIza{long(35)}", f"AIza{long(34)}", f"eyJ{long(20)}.{long(30)}.{long(9)}", f"eyJ{long(39)}", "deadbeefdeadbeef", "token=", "é ", " ", "eyJeyJ", "_", "-"]
        t = "".join(r.choice(whole) for _ in range(r.randint(1, 7))).encode()
        want = sorted([*brute_secrets(t), *((m.start(), m.end(), k) for k, (p, least) in enumerate(ADDED, 3) for m in re.finditer(p.encode(), t) if len(m[1]) >= least)], key=lambda s: (s[0], s[2]))
        assert scanner.scan([t]).get(0, []) == want, t
        seen.update(k for _, _, k in want)
    assert all(seen[k] > 50 for k in range(7) if k != 1)


def test_automaton_agrees_with_re():
    r = random.Random(3)
    for rule in ("ab+c?", "(?:ab|cd){2,3}e", "[a-c]{2,}d", "(?i:ab)[^a]", r"x\x20*y"):
        dfa, p = automaton.Dfa([rule], anywhere=False).prepare(), re.compile(rule)
        for _ in range(400):
            t = "".join(r.choice("abcdeABxy ") for _ in range(10))
            ends = [n for n in range(len(t) + 1) if p.fullmatch(t, 0, n)]
            assert dfa.longest(t.encode(), 0) == (max(ends) if ends and max(ends) else -1), (rule, t)


def test_secret_rows(spark):
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(data.frame(spark)).collect() if r["doc_id"] is not None}
    assert [(s["kind"], s["start"], s["end"]) for s in got[21] if s["base"]] == [("assign", 0, 25), ("access", 27, 47), ("hex", 48, 64)]
    assert got[1] == [] and got[2] == [] and len(got) == len({i for i, _ in data.texts() if i})
    assert [(s["start"], s["end"]) for s in secrets.scan_secrets(data.frame(spark, [(1, "éé deadbeefdeadbeef")])).first()["spans"]] == [(3, 19)]
    assert secrets.scan_secrets(data.empty(spark)).count() == 0


# WARC


def page_rows(spark, rows):
    return spark.createDataFrame([(i, u, h, "c", "c") for i, u, h in rows], "page_id long, url string, html string, payload string, keep_id string")


PAGES = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/é", "<p>é🙂</p>" * 9000), (None, "http://e/", "x"), (None, "http://f/", "only"), (6, "http://g/", "twice"), (6, "http://g/", "twice")]


def test_warc_rows(spark, tmp_path):
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(page_rows(spark, PAGES), str(tmp_path / "w")).collect())
    keep = {}
    for i, _, h in PAGES:
        k = data.raw(h)
        keep[k] = i if keep.get(k) is None else max(keep[k], -1 if i is None else i)
    want = Counter()
    for i, _, h in PAGES:
        k = data.raw(h)
        again = i != keep[k]
        want[i, len(k), warc.sha1_base32(k), "revisit" if again else "response", keep[k] if again else None] += 1
    assert got == want
    assert warc.archive(page_rows(spark, []), str(tmp_path / "none")).count() == 0


def test_warc_payloads_and_urls(spark, tmp_path):
    got = {r["page_id"]: r for r in warc.archive(page_rows(spark, PAGES[:6]), str(tmp_path / "w")).collect()}
    assert bytes(got[5]["payload"]).decode() == PAGES[4][2] and got[1]["payload"] is None and bytes(got[2]["payload"]) == b"x"
    assert got[3]["url"] is None and got[4]["url"] == "http://c/%0D%0AX:%20y"


def test_a_task_that_runs_twice(spark, tmp_path, monkeypatch):
    """The same rows written again in another order and by archives of a few records, as by a second attempt: what the first left is not read."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = [(i, f"http://p/{i}", f"<p>{i}</p>" * (i * 7 % 90)) for i in range(30)]
    path = str(tmp_path / "w")
    kept = lambda order: spark.createDataFrame([(i, u, h.encode(), warc.sha1_base32(h.encode()), i) for i, u, h in order], "page_id long, url string, payload binary, payload_digest string, keep_id long").coalesce(1)
    warc.write_archives(kept(pages), path).collect()
    again = warc.write_archives(kept(pages[::-1]), path).collect()
    assert len(again) > 3 and sum(r["records"] for r in again) == 30
    folders = {f"{path}/{r['folder']}" for r in again}
    assert sorted(r["page_id"] for r in warc.read_archives(spark, *folders).collect()) == list(range(30))
    wrong = next((tmp_path / "w" / again[0]["folder"]).glob("*.zst"))
    wrong.rename(wrong.with_name("part-00000-0000-n99.warc.zst"))
    with pytest.raises(Exception, match="records"):
        warc.read_archives(spark, *folders).collect()


def test_other_records(spark, tmp_path):
    """Archives of other writers: other record types are passed over, other ids and missing digests allowed."""
    record = lambda kind, block, *more: "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1234>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    records = [record("warcinfo", b"software: x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", http, "WARC-Target-URI: http://a/"), record("metadata", b"")]
    (tmp_path / "o.warc.zst").write_bytes(warc.archive_bytes(records, b""))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["page_id"], r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got] == [(None, "<urn:uuid:1234>", 4, warc.sha1_base32(b"body"), "response")]
    with pytest.raises(ValueError):
        warc.parse(record("surprise", b""))


def test_archive_damage():
    record = warc.record_bytes(1, "http://a/", b"body" * 50, warc.sha1_base32(b"body" * 50), None, False)
    assert warc.parse(record)["payload_bytes"] == 200
    words = warc.dictionary([record + bytes([i]) * 40 for i in range(200)])
    data_ = warc.archive_bytes([record, record], words)
    assert words and struct.unpack_from("<I", data_)[0] == warc.DICT_FRAME and list(warc.frames(data_)) == [record, record]
    for bad in (data_[:-3], data_[: 8 + len(words) // 2], data_ + b"junk!", data_[:8] + data_[8 + len(words) :]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.frames(bad))
    for bad in (record[:-1], record.replace(b"Content-Length: ", b"Content-Length: 1", 1), record.replace(b"bodybody", b"bodyBODY", 1), record.replace(b"WARC-Date", b"Date", 1), record.replace(b"WARC/1.1", b"WARX/1.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# Hilbert


def test_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = [g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")]
        place = hilbert.hilbert_index(grid, bits)
        order = np.argsort(place)
        assert sorted(place.tolist()) == list(range(1 << bits * n))
        assert (sum(np.abs(np.diff(g[order])) for g in grid) == 1).all()


def test_shards(spark):
    got = hilbert.hilbert_shards(data.frame(spark), ["lang", "source", "n_chars"], shards=5).collect()
    n = len(data.texts())
    assert len(got) == n and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    size = Counter(r["shard"] for r in got)
    assert set(size) == set(range(5)) and max(size.values()) - min(size.values()) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(size[s]))
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    want = Counter((i, len(data.raw(t)) + 8, zlib.crc32(data.raw(t))) for i, t in data.texts())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert hilbert.hilbert_shards(data.empty(spark), ["lang"]).count() == 0


def test_a_filter_skips_shards(spark, tmp_path):
    """Files by shard hold all rows, and a range of one or two dimensions needs few of them; without an order it would need all."""
    r = random.Random(4)
    langs = ["de", "en", "es", "fr"]
    rows = [(i, f"text {i}", langs[r.randrange(4)], f"site{r.randrange(50):02d}", r.randrange(1, 20000) if i % 40 else None) for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dims = ["lang", "source", "n_chars"]
    ranges = hilbert.write_shards(docs, str(tmp_path / "w"), dims)
    back = spark.read.parquet(str(tmp_path / "w"))
    assert sorted(tuple(x) for x in back.drop("shard").collect()) == sorted(rows) if all(x[4] for x in rows) else back.count() == 4800
    placed = {x["doc_id"]: x["shard"] for x in hilbert.hilbert_shards(docs, dims).collect()}
    assert {x["doc_id"]: x["shard"] for x in back.collect()} == placed
    for wanted, most in (({"lang": ("fr", "fr")}, 14), ({"n_chars": (None, 2000)}, 14), ({"source": ("site00", "site04"), "lang": ("de", "de")}, 6)):
        need = hilbert.shards_to_read(ranges, wanted)
        held = {x["shard"] for x in back.collect() if all((lo is None or (x[c] is not None and x[c] >= lo)) and (hi is None or (x[c] is not None and x[c] <= hi)) for c, (lo, hi) in wanted.items())}
        assert held <= set(need) and len(need) <= most, (wanted, need)


def test_steps_follow_the_values(spark):
    """An independent quantiser: places on the curve of one dimension are in the order of its values, and as full as each other."""
    docs = spark.createDataFrame([(i, "t", None, "s", (i * 7919) % 3000) for i in range(3000)] + [(9999, "t", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.hilbert_shards(docs, ["n_chars"], bits=4).join(docs.select("doc_id", "n_chars"), "doc_id").collect()
    assert [x["curve"] for x in got if x["n_chars"] is None] == [0]
    ordered = sorted((x for x in got if x["n_chars"] is not None), key=lambda x: x["n_chars"])
    assert [x["curve"] for x in ordered] == sorted(x["curve"] for x in ordered)
    assert all(150 <= n <= 450 for n in Counter(x["curve"] for x in ordered).values())


# Preference

TURNS = "pair_id long, chosen boolean, turn long, role string, text string, part string, n1 string"


def test_preference(spark):
    rows_ = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", "why"),
        (2, True, 0, "user", "a"), (2, False, 0, "user", "b"),
        (3, True, 0, "user", "same"), (3, False, 0, "user", "same"),
        (4, True, 0, "user", "alone"),
        (5, True, 0, None, None), (5, False, 0, "", ""), (5, True, None, "assistant", "end"), (5, False, None, "assistant", "fin"),
        (6, True, 0, "user", "x"), (6, True, 0, "user", "x"), (6, False, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows_], TURNS)
    got = preference.preference_segments(df).collect()
    by = lambda p: sorted((r["part"], r["turn"], r["copy"], r["segment"], r["mask_start"], r["mask_end"]) for r in got if r["pair_id"] == p and r["turn"] is not None)
    mark = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    head = len("<|im_start|>assistant\n")
    assert by(1) == [
        ("chosen", 1, 1, mark("assistant", "good"), head, len(mark("assistant", "good"))), ("prompt", 0, 1, mark("user", "hi"), 0, 0),
        ("rejected", 1, 1, mark("assistant", "bad"), head, len(mark("assistant", "bad"))), ("rejected", 2, 1, mark("user", "why"), 0, 0),
    ]
    assert [x[0] for x in by(2)] == ["chosen", "rejected"] and [x[0] for x in by(3)] == ["prompt"] and by(4) == []
    assert [x[0] for x in by(5)] == ["prompt"] and sorted(r["part"] for r in got if r["pair_id"] == 5 and r["turn"] is None) == ["chosen", "rejected"]
    assert [(x[0], x[2]) for x in by(6)] == [("chosen", 1), ("chosen", 2), ("rejected", 1)]
    assert preference.preference_segments(spark.createDataFrame([], TURNS)).count() == 0


def test_preference_pairs(spark):
    """Each pair's texts and masks, against a plain walk over its turns; a very long pair stays in segments."""
    mark = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    turns = [(1, side, k, "user" if k % 2 == 0 else "assistant", f"t{k if k < 3 else (k, side)}é") for side in (True, False) for k in range(6)]
    turns += [(2, True, 0, "assistant", "x" * 500), (2, False, 0, "assistant", "y")]
    df = spark.createDataFrame([(*t, "c", "c") for t in turns], TURNS)
    got = {r["pair_id"]: r for r in preference.preference_pairs(preference.preference_segments(df), longest=400).collect()}
    assert not got[2]["whole"] and got[2]["chosen"] is None and got[2]["n_chars"] > 500
    assert got[1]["prompt"] == "".join(mark(r, t) for _, s, k, r, t in turns[:6] if k < 3)
    for part, side in (("chosen", True), ("rejected", False)):
        text, mask = "", []
        for p, s, k, r, t in turns:
            if p == 1 and s == side and k >= 3:
                if r == "assistant":
                    mask.append((len(text) + len("<|im_start|>assistant\n"), len(text) + len(mark(r, t))))
                text += mark(r, t)
        assert got[1][part] == text and [tuple(m) for m in got[1][f"{part}_mask"]] == mask
    assert preference.preference_pairs(preference.preference_segments(df.limit(0))).count() == 0
