"""Secret scans with one combined automaton.

All rules, with their least lengths, are compiled into one minimal automaton and
every text is scanned for all of them in one pass over its bytes. Bytes that no
rule can use (the resets) lead back to the start from any state, so no match
crosses them. Where a rule ended, the stretch between resets is taken apart by the
same rules as one automaton that begins where a match begins: from each byte that
can begin a match of a kind still free there, one walk follows all kinds at once
and notes the end of the longest match of each and where its body begins, until no
such kind can accept any more. So the matches of each kind are leftmost, longest
and do not overlap, as searches for each kind would give them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa
from .common import bounded_batches, read_table

#: Bytes of text that are scanned as one array.
BLOCK_BYTES = 4 << 20
CHUNK = 256

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
GLUE = r"""["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]"


@dataclass(frozen=True)
class Rule:
    """``search`` finds a stretch (greedy); it counts if its last part, all of ``head`` removed, has ``least`` characters. ``full`` is what the combined automaton looks for: of an added rule only the head and one character, which keeps the product of the counters small."""

    kind: str
    head: str
    body: str
    least: int
    base: bool

    @property
    def search(self) -> str:
        return f"{self.head}{self.body}+"

    @property
    def full(self) -> str:
        return f"{self.head}{self.body}{{{self.least},}}" if self.base else f"{self.head}{self.body}"


#: The base kinds in their order, then what the scan adds.
RULES = (
    Rule("assign", KEYWORD + GLUE, VALUE, 12, True),
    Rule("access", "AKIA", "[A-Z0-9]", 14, True),
    Rule("hex", "", "[0-9a-f]", 16, True),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36, False),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10, False),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35, False),
    Rule("jwt", "eyJ", "[A-Za-z0-9_.-]", 40, False),
)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.all = Dfa([r.full for r in rules], anywhere=True)
        # Bit k: rule k has matched; bit n + k: its head and the first character of its body have.
        self.spans = Dfa([r.search for r in rules] + [r.head + r.body for r in rules], anywhere=False).prepare()
        self.mine = (1 << len(rules)) - 1
        after = [(self.spans.start + kind) for kind in self.spans._kind_list]
        self.first = [self.spans.ahead[self.spans._step_list[at] // self.spans.width] & self.mine for at in after]
        loose = Dfa([r.search for r in rules], anywhere=True)
        self.resets = loose.resets & self.all.resets
        self.reset = int(np.flatnonzero(self.resets)[0])

    def stretch(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches in data, which holds no reset."""
        n, dfa = len(self.rules), self.spans
        step, kind, width, accepts, ahead = dfa._step_list, dfa._kind_list, dfa.width, dfa.accepts, dfa.ahead
        free, found = [0] * n, []
        for at, byte in enumerate(data):
            want = self.first[byte]
            if not want:
                continue
            for k in range(n):
                if want >> k & 1 and free[k] > at:
                    want ^= 1 << k
            end, body, s = {}, {}, dfa.start
            if not want:
                continue
            for i in range(at, len(data)):
                s = step[s + kind[data[i]]]
                state = s // width
                if got := accepts[state]:
                    for k in range(n):
                        if want >> k & 1:
                            if got >> k & 1:
                                end[k] = i + 1
                            if got >> (n + k) & 1:
                                body.setdefault(k, i)
                if not ahead[state] & want:
                    break
            for k, stop in end.items():
                free[k] = stop
                if stop - body[k] >= self.rules[k].least:
                    found.append((at, stop, k))
        return found

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with matches: (start, end, rule) in bytes, by start and then rule."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) < BLOCK_BYTES):
                size += len(texts[to]) + 1
                to += 1
            gap = bytes([self.reset])
            data = gap.join(texts[at:to]) + gap
            array = np.frombuffer(data, "u1")
            hits = self.all.hits(array, CHUNK)
            if len(hits):
                offsets = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
                cut = np.flatnonzero(self.resets[array])
                done = -1
                for h in hits.tolist():
                    low, high = h * CHUNK, min((h + 1) * CHUNK, len(data))
                    i = int(np.searchsorted(cut, low, "left")) - 1
                    begin = int(cut[i]) + 1 if i >= 0 else 0
                    last = int(cut[np.searchsorted(cut, high - 1, "left")])
                    begin = max(begin, done)
                    while begin < last:
                        stop = int(cut[np.searchsorted(cut, begin, "left")])
                        for a, b, k in self.stretch(data[begin:stop]):
                            doc = int(np.searchsorted(offsets, begin + a, "right")) - 1
                            off = int(offsets[doc])
                            out.setdefault(at + doc, []).append((begin + a - off, begin + b - off, k))
                        begin = stop + 1
                    done = max(done, begin)
            at = to
        for spans in out.values():
            spans.sort(key=lambda s: (s[0], s[2]))
        return out


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans counted in code points."""
    if text.isascii():
        return spans
    count = np.concatenate([[0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)])
    return [(int(count[a]), int(count[b]), k) for a, b, k in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<kind,start,end,base>>, in code points, end exclusive.

    Null texts count as empty and, like texts without a match, have no spans.
    Each row is scanned by itself, so null and repeated ids do no harm. Texts of
    any length are scanned whole; other columns are ignored; an empty table gives
    none.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    scanner = Scanner(rules)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(1).cast(pa.binary())]
            found = scanner.scan(texts)
            spans = [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, e, k in code_points(t, found.get(i, []))] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


SQL: dict[str, str] = {}
QUERIES = {"op5_secrets": op5_secrets}
