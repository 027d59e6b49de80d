"""BPE encoding and decoding with forced boundaries.

Two neighbouring characters (of the byte alphabet) that stand side by side
inside no vocabulary token can never end up in one token, for every result of a
merge is a vocabulary token. Between them the cut is certain. Each word is split
at its certain cuts, the fragments are encoded independently and their ids are
concatenated; words and stretches between spaces recur, so both are kept in
bounded caches, which a Python worker keeps from task to task.

The vocabulary file is read on the driver and sent out once; its size is
checked against ``MAX_VOCAB_BYTES``, since it does not grow with the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, per_process, read_table

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are handed on as the machine's own 32-bit integers, which must be little-endian")

MAX_VOCAB_BYTES = 64 << 20
CACHE_ENTRIES = 300_000
LONG_WORD = 200
#: Ids up to which a plain list is faster than a heap.
SHORT = 64
#: Bits of an id.
BITS = 20
END = "</w>"
#: The pre-tokenizer's pattern, white space being what separates matches.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Python parts words at these, the pattern does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible in Latin-1, else the next free one from 256 on."""
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Filled(dict):
    """A dictionary that computes what it lacks and starts anew when it is full; long keys are not kept."""

    def __init__(self, compute, size: int = CACHE_ENTRIES, longest: int = LONG_WORD):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest

    def __missing__(self, key):
        got = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[key] = got
        return got


class BpeCodec:
    """Encoder and decoder for one vocabulary with word ends."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        self.ids = spec["model"]["vocab"]
        if max(self.ids.values()) >= 1 << BITS:
            raise ValueError("the vocabulary has more tokens than ids have room for")
        # A pair of ids, as one number, to its merge: rank above, id of the result below.
        self.pair: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.pair[self.ids[x] << BITS | self.ids[y]] = rank << BITS | self.ids[x + y]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.pieces = [t.encode() for t in self.tokens]
        letters = byte_alphabet()
        self.first = [self.ids.get(c) for c in letters]
        self.last = [self.ids.get(c + END) for c in letters]
        byte = {c: b for b, c in enumerate(letters)}
        #: Whether two bytes, as one number, stand side by side in some token.
        self.inner = bytearray(1 << 16)
        for t in self.ids:
            inside = [byte[c] for c in t.removesuffix(END)]
            for x, y in zip(inside, inside[1:], strict=False):
                self.inner[x << 8 | y] = 1
        self.find = regex.compile(PATTERN).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = Filled(self.word)
        self.stretches = Filled(self.stretch)

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments between certain cuts."""
        inner = self.inner
        at = [i for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if not inner[a << 8 | b]]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def merge(self, s: list[int]) -> list[int]:
        """Apply the merges to the ids by rank, from the left: the merges of all pairs in a list, of which the least is taken each time."""
        get, none, low = self.pair.get, 1 << 62, (1 << BITS) - 1
        found = [get(a << BITS | b, none) for a, b in zip(s, s[1:], strict=False)]
        while found and (least := min(found)) != none:
            i = found.index(least)
            s[i : i + 2] = [least & low]
            del found[i]
            if i:
                found[i - 1] = get(s[i - 1] << BITS | s[i], none)
            if i < len(found):
                found[i] = get(s[i] << BITS | s[i + 1], none)
        return s

    def merge_long(self, s: list[int]) -> list[int]:
        """merge for many ids: a heap over a linked list."""
        get, low, end = self.pair.get, (1 << BITS) - 1, len(s)
        right, left = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(m, i) for i, p in enumerate(zip(s, s[1:], strict=False)) if (m := get(p[0] << BITS | p[1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = right[i]
            if s[i] < 0 or j >= end or get(s[i] << BITS | s[j]) != m:
                continue
            s[i], s[j] = m & low, -1
            right[i] = right[j]
            if right[i] < end:
                left[right[i]] = i
                if (n := get(s[i] << BITS | s[right[i]])) is not None:
                    heapq.heappush(heap, (n, i))
            if left[i] >= 0 and (n := get(s[left[i]] << BITS | s[i])) is not None:
                heapq.heappush(heap, (n, left[i]))
        return [x for x in s if x >= 0]

    def word(self, word: str) -> bytes:
        raw, ids = word.encode("utf-8", "replace"), []
        *heads, tail = self.cuts(raw)
        for part in heads:
            ids += self.fragment([self.first[b] for b in part])
        ids += self.fragment([*(self.first[b] for b in tail[:-1]), self.last[tail[-1]]])
        return array("I", ids).tobytes()

    def fragment(self, ids: list[int]) -> list[int]:
        return self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def stretch(self, text: str) -> bytes:
        """The ids of lower-cased text; words never cross white space, so a text's stretches between spaces may be encoded one by one."""
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # Letter by letter: the final sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in NOT_SPACE):
            return self.stretch(text)
        return b"".join(map(self.stretches.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in self.marks.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8. The file names no decoder, so tokens are joined by single spaces."""
        return b" ".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


def load(spark: SparkSession, path: str):
    bounded_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary is over {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The general form: (doc_id, ids array<long>, decoded string) for each row of docs; a null text counts as empty."""
    vocabulary = load(docs.sparkSession, path)

    def run(batches):
        codec = per_process(("bpe", hashlib.sha256(vocabulary.value).hexdigest()), lambda: BpeCodec(vocabulary.value))
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([np.frombuffer(x, "<u4").astype("i8") for x in ids], pa.list_(pa.int64())), pa.array([codec.decode(x).decode() for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are encoded whole, without special tokens around them; special tokens
    that stand in a text are encoded as such. Null and empty texts have no
    tokens. Ids may be null or repeated; each row is encoded by itself and other
    columns are ignored. An empty table gives an empty result.
    """
    vocabulary = load(docs.sparkSession, path)

    def run(batches):
        codec = per_process(("bpe", hashlib.sha256(vocabulary.value).hexdigest()), lambda: BpeCodec(vocabulary.value))
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids = codec.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


SQL: dict[str, str] = {}
QUERIES = {"op4_bpe": op4_bpe}
