"""WARC archives under Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: each task turns its rows into one or more archives of a bounded size,
with a dictionary trained on a bounded head of its own payloads. Each attempt of a
task writes to a folder of its own, and only the folders that the finished attempts
report are read: rows may come to a second attempt in another order and be cut
into other archives, and what a lost or slower attempt left is never looked at. An
archive's name says how many records it holds.

Reading: Spark lists and opens the archives, so any store that Spark reads will
do. The reader loads the dictionary from the skippable frame, decodes one frame
per record and checks every length and header; a damaged archive, or one with
another number of records than its name says, raises. Records of other types than
response and revisit (warcinfo, request, metadata, ...) are checked and passed over.

Records with equal payloads: the one with the largest page id is the response,
the others are revisits that name it and keep only the HTTP head. The digest of
a page and its length decide equality (SHA-1 for the record, SHA-256 beside it).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, scratch_path, with_class_winner

#: Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 32 << 20
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 32 << 10
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
#: The record types of the format that hold no response.
PASSED = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return "<urn:x-page:" + ("null" if page_id is None else str(page_id)) + ">"


def from_urn(value: str | None) -> int | None:
    """The page that a record id of ours names; none for the ids of other writers."""
    body = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(body) if body.removeprefix("-").isdigit() and value == f"<urn:x-page:{body}>" else None


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "urn:x-none:")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none if the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes], dict_data: bytes) -> bytes:
    out = []
    if dict_data:
        out.append(struct.pack("<II", DICT_FRAME, len(dict_data)) + dict_data)
        box = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dict_data), write_checksum=True, write_content_size=True)
    else:
        box = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    out += map(box.compress, records)
    return b"".join(out)


def frames(data: bytes):
    """Each record of an archive, decoded frame by frame."""
    at, known = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        n = struct.unpack_from("<I", data, 4)[0]
        if 8 + n > len(data):
            raise ValueError("the dictionary frame is cut short")
        raw = bytes(view[8 : 8 + n])
        if n >= 4 and struct.unpack_from("<I", raw)[0] == ZSTD_FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known, at = zstandard.ZstdCompressionDict(raw), 8 + n
    box = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 4 > len(data) or struct.unpack_from("<I", data, at)[0] != ZSTD_FRAME:
            raise ValueError(f"no frame begins at byte {at}")
        # Frames cannot be skipped without decoding, so each is fed in growing pieces of the rest.
        one, pieces, pos = box.decompressobj(), [], at
        while not one.eof:
            piece = view[pos : pos + 65536]
            if not piece:
                raise ValueError("the last frame is cut short")
            pieces.append(one.decompress(piece))
            pos += len(piece)
        at = pos - len(one.unused_data)
        yield b"".join(pieces)


def head_of(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("a header does not end")
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad or repeated header line: {line!r}")
        fields[name.lower()] = value.strip()
    return first, fields, end + 4


def parse(record: bytes) -> dict | None:
    """Validate one record and take it apart; None for a sound record of a type that is passed over."""
    version, head, at = head_of(record, 0)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version!r}")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise ValueError(f"the record lacks {need}")
    n = int(head["content-length"])
    if len(record) != at + n + 4 or record[at + n :] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    block = record[at : at + n]
    checked(head.get("warc-block-digest"), block, "block")
    kind = head["warc-type"]
    if kind in PASSED:
        return None
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind!r}")
    status, http, start = head_of(block, 0)
    if not status.startswith("HTTP/"):
        raise ValueError("the block is no HTTP response")
    payload = block[start:]
    size = int(http.get("content-length", len(payload)))
    if kind == "response":
        if len(payload) != size:
            raise ValueError("the payload's length is wrong")
        checked(head.get("warc-payload-digest"), payload, "payload")
        digest = sha1_base32(payload)
    else:
        if payload or not head.get("warc-profile", "").endswith("/revisit/identical-payload-digest") or "warc-refers-to" not in head or "warc-payload-digest" not in head:
            raise ValueError("the revisit record is not one of identical payloads")
        digest = head["warc-payload-digest"].partition(":")[2]
    uri, refers = head.get("warc-target-uri"), head["warc-refers-to"] if kind == "revisit" else None
    return {
        "page_id": from_urn(head["warc-record-id"]), "url": None if uri == "urn:x-none:" else uri, "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": from_urn(refers), "record_id": head["warc-record-id"], "refers_to_id": refers,
    }


def checked(digest: str | None, data: bytes, what: str) -> None:
    """Raise if a labelled SHA-1 digest is not that of data; digests by other algorithms cannot be checked and pass."""
    label, _, value = (digest or "").partition(":")
    if label.lower() == "sha1" and value.upper() != sha1_base32(data):
        raise ValueError(f"the {what} digest is wrong")


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Write rows (page_id, url, payload, payload_digest, keep_id) as archives under path; returns (folder, archive, records), one row an archive. Only the folders that come back hold finished work."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        place, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        if isinstance(place, fs.LocalFileSystem):
            root = root.removeprefix("file:")
        folder = f"attempt-{part:05d}-{uuid.uuid4().hex}"
        place.create_dir(f"{root}/{folder}", recursive=True)
        held, size, k, dict_data = [], 0, 0, None

        def flush():
            nonlocal held, size, k, dict_data
            if dict_data is None:
                samples, n = [], 0
                for r in held[:SAMPLE_RECORDS]:
                    if n < SAMPLE_BYTES:
                        samples.append(r[:65536])
                        n += len(samples[-1])
                dict_data = dictionary(samples)
            name = f"part-{part:05d}-{k:04d}-n{len(held)}.warc.zst"
            with place.open_output_stream(f"{root}/{folder}/{name}", compression=None) as f:  # the name must not make the stream compress what is compressed
                f.write(archive_bytes(held, dict_data))
            out = pa.RecordBatch.from_pydict({"folder": [folder], "archive": [name], "records": pa.array([len(held)], pa.int64())})
            held, size, k = [], 0, k + 1
            return out

        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(b.num_rows):
                page, url, payload, digest, keep = (c[i].as_py() for c in cols)
                held.append(record_bytes(page, url, payload, digest, keep, page != keep))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return rows.select("page_id", "url", "payload", "payload_digest", "keep_id").mapInArrow(run, "folder string, archive string, records long")


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of all archives in folders: see RECORD. A revisit has no payload of its own; page_id and refers_to are null where another writer named the records."""

    def run(batches):
        from collections import deque

        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                rows, size, n = deque(), 0, 0
                for r in frames(data.as_py()):
                    n += 1
                    if (found := parse(r)) is None:
                        continue
                    rows.append(found)
                    size += len(r)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = deque(), 0
                said = re.search(r"-n(\d+)\.warc\.zst$", path.as_py())
                if said and n != int(said[1]):
                    raise ValueError(f"{path} holds {n} records")
                if rows:
                    yield batch(rows)

    types = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "refers_to_id": pa.string()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in types.items()], list(types))

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(list(paths))
    return found.select("path", "content").mapInArrow(run, RECORD)


def with_payload(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for b in batches:
            raw = [x.as_py() or b"" for x in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(map(sha1_base32, raw), pa.string()), pa.array((hashlib.sha256(x).digest() for x in raw), pa.binary())],
                ["page_id", "url", "payload", "payload_digest", "content"],
            )

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, payload binary, payload_digest string, content binary")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as archives under path and read them back: see RECORD.

    A null html is an empty payload; empty payloads are equal to each other like
    any others. Null page ids rank below all others; a class of only null ids is
    all responses, as are rows that repeat the id of the response. A null url is
    written as ``urn:x-none:``. Other columns are ignored. An empty table writes
    no archive and gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = with_payload(pages)
    classes = with_class_winner(rows.select("page_id", "content", "payload_digest"), ["content", "payload_digest"], "page_id")
    keep = classes.groupBy(F.col("page_id").alias("id"), F.col("content").alias("c")).agg(F.max("keep_id").alias("keep_id"))
    joined = rows.join(keep, rows["page_id"].eqNullSafe(keep["id"]) & (rows["content"] == keep["c"]))
    folders = [r["folder"] for r in write_archives(joined, path).groupBy("folder").count().collect()]  # one a task
    return read_archives(spark, *[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL: dict[str, str] = {}
QUERIES = {"op2_warc": op2_warc}
