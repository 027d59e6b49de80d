"""SQL access: the sources as temporary views, and the readers called from SQL.

``query`` runs a statement in which readers stand where tables do, with windows
and all other arguments named or in order:

    query(h, "SELECT key, pct FROM top('query_id', since => '2026-03-02T11:00', n => 5)")

A reader plans in Python (its source is part of the answer), so each call is
planned before the statement runs and stands in it as a view. ``register`` makes
table functions of the session for one window instead.
"""

from __future__ import annotations

import ast
import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import History
from .model import ActivityError
from .operators import legacy, readers, render, report

VIEWS = ("observations", "rollup_1m", "rollup_1h")
#: Keys that a registered top function can return.
MOST_KEYS = 10_000
READERS = {
    "aas": readers.aas, "timeline": readers.timeline, "periods": readers.periods, "top": readers.top, "compare": readers.compare, "samples": readers.samples,
    "report": report.report_json, "chart": render.chart, "summary": render.summary, "status": render.status,
    "top_waits": legacy.top_waits, "wait_timeline": legacy.wait_timeline, "top_queries": legacy.top_queries, "top_by_type": legacy.top_by_type, "query_waits": legacy.query_waits,
    "event_queries": legacy.event_queries, "samples_by_database": legacy.samples_by_database, "activity_summary": legacy.activity_summary, "minute_waits": legacy.minute_waits,
    "hourly_queries": legacy.hourly_queries, "daily_peak_backends": legacy.daily_peak_backends,
}
TOKEN = re.compile(r"""(?P<text>'(?:[^']|'')*')|(?P<call>\b(?:from|join)\s+(?P<name>\w+)\s*\()|(?P<any>.)""", re.IGNORECASE | re.DOTALL)


def _value(text: str):
    """A literal: text, number, true, false or null; a type name before a text is allowed."""
    m = re.fullmatch(r"(?:(?:timestamp|interval|date)\s+)?'((?:[^']|'')*)'", text.strip(), re.IGNORECASE | re.DOTALL)
    if m:
        return m[1].replace("''", "'")
    word = {"null": None, "true": True, "false": False}
    if text.strip().lower() in word:
        return word[text.strip().lower()]
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        raise ActivityError(f"an argument must be a literal, not {text.strip()!r}") from None


def _arguments(text: str) -> tuple[list, dict]:
    parts, depth = [""], 0
    for m in TOKEN.finditer(text):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    plain, named = [], {}
    for part in filter(str.strip, parts):
        m = re.match(r"\s*(\w+)\s*=>\s*(.*)", part, re.DOTALL)
        if m:
            named[m[1].lower()] = _value(m[2])
        else:
            plain.append(_value(part))
    return plain, named


def query(h: History, text: str) -> DataFrame:
    """The result of a statement over the views of VIEWS and, after FROM or JOIN, the readers."""
    for name, df in zip(VIEWS, (h.rows(), h.minutes, h.hours), strict=True):
        df.createOrReplaceTempView(name)
    out, at = [], 0
    while m := TOKEN.match(text, at):
        at = m.end()
        reader = READERS.get((m["name"] or "").lower())
        if reader is None:
            out.append(m[0])
            continue
        end, depth = at, 1
        while depth:
            t = TOKEN.match(text, end)
            if t is None:
                raise ActivityError(f"the call of {m['name']} does not end")
            depth += t[0].endswith("(") - (t[0] == ")")
            end = t.end()
        plain, named = _arguments(text[at : end - 1])
        view = f"{m['name'].lower()}_{uuid.uuid4().hex}"
        reader(h, *plain, **named).createOrReplaceTempView(view)
        out.append(m[0][: m.start("name") - m.start()] + view)
        at = end
    return h.spark.sql("".join(out))


def register(h: History, since=None, until=None, prefix: str = "") -> list[str]:
    """Create the views and, over [since, until), the table functions aas, timeline, top and samples; returns all names."""
    spark = h.spark
    for name, df in zip(VIEWS, (h.rows(), h.minutes, h.hours), strict=True):
        df.createOrReplaceTempView(f"{prefix}{name}")
    made = [f"{prefix}{v}" for v in VIEWS]
    frames = {
        "aas": (readers.aas(h, since, until), "at_least DOUBLE DEFAULT 0", "avg_aas >= at_least"),
        "timeline": (readers.timeline(h, since, until), "at_least DOUBLE DEFAULT 0", "coalesce(avg_aas, 0) >= at_least"),
        "samples": (readers.samples(h, since, until, (1 << 31) - 1), "wait STRING DEFAULT NULL", "wait IS NULL OR wait_event = wait"),
    }
    for dim in readers.DIMENSIONS:
        leading = readers.top(h, dim, since, until, n=MOST_KEYS)  # cut before it is numbered
        order = Window.orderBy(F.col("backend_seconds").desc(), F.col("key").asc_nulls_last())
        frames[f"top_{dim}"] = (leading.withColumn("place", F.row_number().over(order)), "n INT DEFAULT 10", "place <= n")
    for name, (df, argument, cond) in frames.items():
        view, function = f"{prefix}{name}_rows", f"{prefix}{name}"
        df.createOrReplaceTempView(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({argument}) RETURNS TABLE({columns}) RETURN SELECT * FROM {view} WHERE {cond}")
        made += [view, function]
    return made
