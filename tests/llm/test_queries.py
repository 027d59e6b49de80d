"""The registered queries, as they are registered, on a small table in files."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from tests.llm import data, test_corpus, test_texts

from tickfold.llm import bpe, registry, warc


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    data.frame(spark).write.parquet(f"{top}/documents.parquet")
    items = [(1, data.prose(3, 90)), (2, "one"), (3, None)]
    test_corpus.item_frame(spark, items).write.parquet(f"{top}/benchmark.parquet")
    test_texts.page_rows(spark, test_texts.PAGES).write.parquet(f"{top}/pages.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t if t < 2 else c}") for c in range(7) for t in range(4)] + [(2, 9, None, None), (None, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    spark.createDataFrame([(6, 1, 0), (24, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder)


def test_names():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = run(spark, folder, name)
    want = con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    if name == "op6_exact_dedup":
        columns.remove("keep_id")  # a null id is told apart below
    pick = lambda rows, names: Counter(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in rows)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), want.columns)


def test_op1(spark, folder):
    got = run(spark, folder, "op1_parsing")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == test_corpus.brute_passages(data.texts(), 400)


def test_op2(spark, folder):
    got = run(spark, folder, "op2_warc").collect()
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _, _ in test_texts.PAGES)
    for r in got:
        payloads = {data.raw(h) for i, _, h in test_texts.PAGES if i == r["page_id"]}
        assert any(r["payload_bytes"] == len(p) and r["payload_digest"] == warc.sha1_base32(p) for p in payloads)
        assert (r["record_type"] == "revisit") == (r["refers_to"] is not None)


def test_op4(spark, folder):
    codec = bpe.BpeCodec(open(bpe.vocabulary_path(), "rb").read())
    want = Counter()
    for i, t in data.texts():
        ids = codec.encode(t or "")
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()] += 1
    assert Counter(tuple(r) for r in run(spark, folder, "op4_bpe").collect()) == want


def test_op5(spark, folder):
    kinds = ("assign", "access", "hex")
    want = Counter()
    for i, t in data.texts():
        b = data.raw(t)
        spans = [(len(b[:s].decode()), len(b[:e].decode()), k) for s, e, k in test_texts.brute_secrets(b)]
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in spans)
        want[(i, *(sum(k == j for _, _, k in spans) for j in range(3)), hashlib.sha256(text.encode()).hexdigest(), text)] += 1
    assert Counter(tuple(r) for r in run(spark, folder, "op5_secrets").collect()) == want


def test_op7(spark, folder):
    got = run(spark, folder, "op7_hilbert").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(data.raw(t)) + 8, zlib.crc32(data.raw(t))) for i, t in data.texts())
    per = Counter(r["shard"] for r in got)
    assert set(per) <= set(range(24)) and max(per[s] for s in range(24)) - min(per[s] for s in range(24)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s])) for s in per)


def test_op8(spark, folder):
    got = run(spark, folder, "op8_resample").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(len(got))) and all(r["kept"] for r in got)


def test_op9(spark, folder):
    got = run(spark, folder, "op9_simhash").collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{test_corpus.brute_fingerprint(t):016x}") for i, t in data.texts())
