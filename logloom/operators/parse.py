"""Raw line -> structured log fields, as a chain of built-in expressions.

Order of the decision (first that yields a severity or attributes wins):
JSON object, then logfmt, then the four severity patterns.  A non-empty
``msg`` attribute (or one of its aliases) replaces the message and leaves
the map.  Each stage is its own projection column: a stage used twice is
not inlined by the optimizer, so no regular expression or JSON parse runs
twice on a line, and scalar work stays in generated code; lambdas only
walk the (small) per-line arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.bind import pinned
from logloom.functions.attrs import entries_to_map, last_wins, normalize_entries, with_pod_uid
from logloom.functions.jsonattrs import (json_string_fields, json_value_entries, object_members,
                                         parse_object, typed_members)
from logloom.functions.logfmt import is_logfmt_candidate, logfmt_pairs
from logloom.functions.severity import severity_from_fields, severity_from_pattern
from logloom.functions.timestamps import message_after_prefix, prefix_ns

_P = "__p_"
_NO_ENTRIES = "array<struct<key:string,value:string>>"


def _c(name: str) -> Column:
    return F.col(_P + name)


def _json_stages(body: Column) -> list[dict[str, Column]]:
    """JSON: parse once, keep the last of duplicate keys, type the values."""
    return [{_P + "pj": parse_object(body)},
            {_P + "jm": object_members(_c("pj"))},
            {_P + "ju": last_wins(_c("jm"))},
            {_P + "jt": typed_members(_c("ju"))}]


def with_json_entries(df: DataFrame, message: str, to: str) -> DataFrame:
    """``json_entries`` of a column, each step a projection of its own: in one
    expression the optimizer would copy every step into all of its uses."""
    out = df
    for stage in _json_stages(F.col(message)):
        out = out.withColumns(stage)
    return out.withColumn(to, _c("jt")).drop(*[c for c in out.columns if c.startswith(_P)])


def with_logfmt_fields(df: DataFrame, message: str, to: str) -> DataFrame:
    """``logfmt_fields`` of a column, where it is no JSON object, in the same way."""
    out = df.withColumn(_P + "lp", F.when(~F.col(message).startswith("{"), logfmt_pairs(F.col(message))))
    return out.withColumn(to, last_wins(_c("lp"))).drop(_P + "lp")


def _stages(src: Column, ingest: Column) -> list[dict[str, Column]]:
    """The parse as ordered projection stages (name -> expression)."""
    body = _c("body")
    return [
        {_P + "ns": prefix_ns(src)},
        {_P + "ts": F.coalesce(_c("ns"), ingest.cast("long")), _P + "body": message_after_prefix(src, _c("ns"))},
        *_json_stages(body),
        {_P + "jsev": severity_from_fields(json_string_fields(_c("jt"))),
         _P + "jent": F.when(_c("jt").isNotNull(), normalize_entries(json_value_entries(_c("jt"))))},
        {_P + "jhit": F.coalesce((_c("jsev") > 0) | (F.size(_c("jent")) > 0), F.lit(False))},
        # logfmt, only where JSON gave nothing
        {_P + "lp": F.when(~_c("jhit") & is_logfmt_candidate(body), logfmt_pairs(body))},
        {_P + "lf": last_wins(_c("lp"))},
        {_P + "lsev": F.when(F.size(_c("lf")) > 0, severity_from_fields(F.map_from_entries(_c("lf")))),
         _P + "lent": F.when(F.size(_c("lf")) > 0, normalize_entries(F.filter(_c("lf"), lambda x: x["value"] != "")))},
        {_P + "lhit": ~_c("jhit") & F.coalesce((_c("lsev") > 0) | (F.size(_c("lent")) > 0), F.lit(False))},
        {_P + "sev": F.when(_c("jhit"), _c("jsev")).when(_c("lhit"), _c("lsev"))
         .otherwise(severity_from_pattern(body)).cast("int"),
         _P + "ent": F.when(_c("jhit"), _c("jent")).when(_c("lhit"), _c("lent"))
         .otherwise(F.lit(None).cast(_NO_ENTRIES))},
        {"ts_ns": _barrier(_c("ts")),
         "severity": _barrier(_c("sev")),
         "message": _barrier(F.coalesce(
             F.try_element_at(F.filter(_c("ent"), lambda x: x["key"] == "msg"), F.lit(1))["value"], body)),
         "attributes": _barrier(entries_to_map(F.filter(_c("ent"), lambda x: x["key"] != "msg")))},
    ]


def _barrier(c: Column) -> Column:
    """Filters on parsed columns stay above the parse: pushed below, they
    would re-run the parse inside the filter and inline every shared stage
    into one ever-growing expression."""
    return pinned(c)


# Built expressions are unresolved and reusable across frames: build once.
_STAGE_CACHE: dict[tuple, list[dict[str, Column]]] = {}


def parse_lines(df: DataFrame, ingest_ns: Column | int | str = "ingest_ns", line: str = "line",
                keep_line: bool = False) -> DataFrame:
    """Add ``ts_ns``, ``severity``, ``message``, ``attributes`` parsed from ``line``.

    ``ingest_ns`` is the time given to lines without a valid timestamp prefix:
    a column name, a column, or a fixed number (never a clock read).
    """
    if isinstance(ingest_ns, Column):
        stages = _stages(F.col(line), ingest_ns)
    else:
        key = (line, ingest_ns)
        stages = _STAGE_CACHE.get(key)
        if stages is None:
            ingest = F.col(ingest_ns) if isinstance(ingest_ns, str) else F.lit(int(ingest_ns))
            stages = _STAGE_CACHE[key] = _stages(F.col(line), ingest)
    out = df.drop(*[c for c in ("ts_ns", "severity", "message", "attributes") if c in df.columns])
    for stage in stages:
        out = out.withColumns(stage)
    drop = [c for c in out.columns if c.startswith(_P)]
    if not keep_line:
        drop.append(line)
    return out.drop(*drop)


def to_log_entry(parsed: DataFrame) -> DataFrame:
    """Parsed line -> log entry: attributes always carry ``pod_uid``."""
    return parsed.withColumn("attributes", with_pod_uid(F.col("attributes"), F.col("pod_uid")))
