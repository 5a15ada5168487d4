"""The one query shape of the log store: a conjunction of optional filters.

Every filter is pushed to the Parquet scan where Spark can (time, namespace,
pod, container, severity, id cursors); the time range also adds the implied
``log_date`` bounds so whole date partitions are pruned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.attrs import attr_equals
from logloom.operators.search import Match, all_words, search

NS_PER_S = 1_000_000_000
DEFAULT_LIMIT = 100
HTTP_MAX_LIMIT = 1000


def _utc_day(ns: int):
    return date(1970, 1, 1) + timedelta(days=ns // (86_400 * NS_PER_S))


_RFC3339 = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_INT64 = 1 << 63


def _parse_rfc3339(text: str) -> int | None:
    """RFC3339 (whole seconds or fraction) -> ns; None when malformed or
    outside the range of a BIGINT."""
    m = _RFC3339.fullmatch(text)
    if not m:
        return None
    try:
        dt = datetime.fromisoformat(m.group(1) + m.group(3).replace("Z", "+00:00"))
        secs = (dt - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    except (ValueError, OverflowError):
        return None
    ns = secs * NS_PER_S + int((m.group(2) or "")[:9].ljust(9, "0"))
    return ns if -_INT64 <= ns < _INT64 else None


def _parse_int(text: str) -> int | None:
    """A signed 64-bit decimal; None when it is anything else."""
    if not _INTEGER.fullmatch(text or "") or len(text) > 40:
        return None
    value = int(text)
    return value if -_INT64 <= value < _INT64 else None


@dataclass(frozen=True)
class LogQuery:
    """Filters (None = not set), cursor and page size.  Times in Unix ns:
    ``start_ns`` inclusive, ``end_ns`` exclusive."""

    start_ns: int | None = None
    end_ns: int | None = None
    search: str | Match | None = None
    namespace: str | None = None
    pod: str | None = None
    container: str | None = None
    min_severity: int = 0
    attributes: Mapping[str, str] = field(default_factory=dict)
    after_id: int | None = None
    before_id: int | None = None
    limit: int = DEFAULT_LIMIT
    order: str = "desc"

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> "LogQuery":
        """Build from HTTP-style text parameters.  Malformed limit (<=0 or
        >1000), severity (not 0..6), cursors and times are ignored silently;
        only ``order=asc`` switches the order; ``attr.<key>`` filters."""
        kw: dict = {}
        for name in ("namespace", "pod", "container", "search"):
            if params.get(name):
                kw[name] = params[name]
        sev = _parse_int(params.get("minSeverity", ""))
        if sev is not None and 0 <= sev <= 6:
            kw["min_severity"] = sev
        lim = _parse_int(params.get("limit", ""))
        if lim is not None and 0 < lim <= HTTP_MAX_LIMIT:
            kw["limit"] = lim
        for name, key in (("afterId", "after_id"), ("beforeId", "before_id")):
            v = _parse_int(params.get(name, ""))
            if v is not None:
                kw[key] = v
        if params.get("order") == "asc":
            kw["order"] = "asc"
        for name, key in (("startTime", "start_ns"), ("endTime", "end_ns")):
            if params.get(name):
                ns = _parse_rfc3339(params[name])
                if ns is not None:
                    kw[key] = ns
        attrs = {k[len("attr."):]: v for k, v in params.items() if k.startswith("attr.")}
        if attrs:
            kw["attributes"] = attrs
        return cls(**kw)

    @classmethod
    def from_tail_params(cls, params: Mapping[str, str]) -> tuple["LogQuery", int | None]:
        """Live-tail request: the same filters but no end time, page size,
        order or cursors; ``lastId`` (a positive integer) resumes a viewer."""
        keep = {k: v for k, v in params.items()
                if k in ("namespace", "pod", "container", "search", "minSeverity", "startTime") or k.startswith("attr.")}
        last = _parse_int(params.get("lastId", ""))
        return cls.from_params(keep), last if last is not None and last > 0 else None

    @classmethod
    def last(cls, minutes: int, now_ns: int, **kw) -> "LogQuery":
        """Relative span: the last ``minutes`` before ``now_ns`` (0 = all time)."""
        if minutes <= 0:
            return cls(**kw)
        return cls(start_ns=now_ns - minutes * 60 * NS_PER_S, **kw)

    def with_(self, **kw) -> "LogQuery":
        return replace(self, **kw)

    @property
    def page_size(self) -> int:
        return self.limit if self.limit > 0 else DEFAULT_LIMIT

    def search_match(self) -> Match | None:
        if isinstance(self.search, str):
            return all_words(self.search)
        return self.search

    def days(self) -> Column:
        """The implied bounds on ``log_date``."""
        out = F.lit(True)
        if self.start_ns is not None:
            out = out & (F.col("log_date") >= F.lit(_utc_day(self.start_ns)))
        if self.end_ns is not None:
            out = out & (F.col("log_date") <= F.lit(_utc_day(self.end_ns)))
        return out

    def condition(self, has_log_date: bool = False, with_cursor: bool = True) -> Column:
        """The conjunction of all set filters but full text (TRUE when none
        is set); see :func:`apply_query` for the full-text part."""
        conds: list[Column] = []
        if self.start_ns is not None:
            conds.append(F.col("ts_ns") >= F.lit(self.start_ns))
            if has_log_date:
                conds.append(F.col("log_date") >= F.lit(_utc_day(self.start_ns)))
        if self.end_ns is not None:
            conds.append(F.col("ts_ns") < F.lit(self.end_ns))
            if has_log_date:
                conds.append(F.col("log_date") <= F.lit(_utc_day(self.end_ns)))
        for name in ("namespace", "pod", "container"):
            v = getattr(self, name)
            if v:
                conds.append(F.col(name) == F.lit(v))
        if self.min_severity > 0:
            conds.append(F.col("severity") >= F.lit(self.min_severity))
        for k in sorted(self.attributes):
            conds.append(attr_equals("attributes", k, self.attributes[k]))
        if with_cursor:
            if self.after_id is not None and self.after_id > 0:
                conds.append(F.col("id") > F.lit(self.after_id))
            if self.before_id is not None and self.before_id > 0:
                conds.append(F.col("id") < F.lit(self.before_id))
        out = F.lit(True)
        for c in conds:
            out = out & c
        return out


def apply_query(df: DataFrame, q: LogQuery, with_cursor: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """All filters of ``q`` (no order, no limit).  Scan-pushable filters come
    first; full text last, on the rows that are left: from the posting lists
    where they are given and can answer, else from the terms column."""
    plain = df.where(q.condition(has_log_date="log_date" in df.columns, with_cursor=with_cursor))
    match = q.search_match()
    if postings is not None and match is not None:
        from logloom.operators.postings import search_postings

        if "log_date" in df.columns and "log_date" in postings.columns:
            postings = postings.where(LogQuery(start_ns=q.start_ns, end_ns=q.end_ns).days())
        return search_postings(plain, postings, match)
    return search(plain, match)


def project_entry(df: DataFrame) -> DataFrame:
    """Entry -> one JSON document per row, the shape the store serves:
    id, timestamp (Unix ns), namespace, pod, container, severity, message,
    attrs (keys sorted; omitted when there are none).  Characters are not
    HTML-escaped."""
    attrs = F.when(F.size(F.col("attributes")) > 0,
                   F.map_from_entries(F.array_sort(F.map_entries(F.col("attributes")))))
    doc = F.struct(F.col("id").alias("id"), F.col("ts_ns").alias("timestamp"), "namespace", "pod", "container",
                   F.col("severity").cast("int").alias("severity"), "message", attrs.alias("attrs"))
    return df.select("id", F.to_json(doc).alias("json"))


# ------------------------------------------------------------ saved queries

_EQUAL = ("namespace", "pod", "container")


def saved_queries(spark, queries: Mapping[str, LogQuery]) -> DataFrame:
    """Named queries as a table: a row per query with its filters.  ``mask``
    says which of namespace, pod and container it asks for, ``wanted`` their
    values: the key by which rows find it."""
    rows = []
    for name, q in queries.items():
        asked = [getattr(q, f) or None for f in _EQUAL]
        after, before = (c if c is not None and c > 0 else None for c in (q.after_id, q.before_id))
        rows.append((name, sum(1 << k for k, v in enumerate(asked) if v), [v for v in asked if v], q.start_ns, q.end_ns,
                     q.min_severity, dict(q.attributes), after, before, q.search_match() is not None))
    return spark.createDataFrame(rows, "query string, mask int, wanted array<string>, start_ns bigint, end_ns bigint, "
                                       "min_severity int, attrs map<string,string>, after_id bigint, before_id bigint, searches boolean")


def match_saved(df: DataFrame, queries: Mapping[str, LogQuery]) -> DataFrame:
    """(query, id): every row of ``df`` with every query it matches, in one
    scan.  Rows are looked up by the values of namespace, pod and container
    that queries ask for, once for each combination of these fields in use, and
    only the queries found so are tried; full text is tested before, on rows
    that meet the other filters of a query that searches."""
    if not queries:
        return df.select(F.lit("").alias("query"), "id").where("false")
    table = saved_queries(df.sparkSession, queries)
    masks = sorted({sum(1 << k for k, f in enumerate(_EQUAL) if getattr(q, f)) for q in queries.values()})
    searches = {name: q for name, q in queries.items() if q.search_match() is not None}
    days = [q for q in queries.values()]
    rows = df
    if "log_date" in df.columns and all(q.start_ns is not None for q in days):
        rows = rows.where(F.col("log_date") >= F.lit(_utc_day(min(q.start_ns for q in days))))
    if "log_date" in df.columns and all(q.end_ns is not None for q in days):
        rows = rows.where(F.col("log_date") <= F.lit(_utc_day(max(q.end_ns for q in days))))
    cols = ["id", "ts_ns", "severity", "attributes", *_EQUAL]
    found = F.array().cast("array<string>")
    if searches:
        from logloom.operators.search import TERMS, with_terms

        near = F.lit(False)
        for q in searches.values():
            near = near | q.condition()
        if TERMS not in rows.columns:  # stem only what some searching query could meet
            stemmed = with_terms(rows.where(near)).select(*cols, TERMS)
            rest = rows.where(~near | near.isNull()).select(*cols, F.lit(None).cast("array<string>").alias(TERMS))
            rows = stemmed.unionByName(rest)
        found = F.array_compact(F.array(*[
            F.when(F.coalesce(q.condition() & q.search_match().column(F.col(TERMS)), F.lit(False)), F.lit(name))
            for name, q in searches.items()]))
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), F.array(
        *[F.col(f) for k, f in enumerate(_EQUAL) if m >> k & 1]).cast("array<string>").alias("wanted")) for m in masks])
    rows = rows.select("id", "ts_ns", "severity", "attributes", found.alias("found"), F.inline(keys))
    # the queries are the small side, however small the rows' files look
    q = F.broadcast(table.toDF(*[f"q_{c}" for c in table.columns]))
    has = F.forall(F.map_entries("q_attrs"), lambda e: F.coalesce(F.element_at(F.col("attributes"), e["key"]) == e["value"], F.lit(False)))
    meets = ((F.col("mask") == F.col("q_mask")) & (F.col("wanted") == F.col("q_wanted"))
             & (F.col("q_start_ns").isNull() | (F.col("ts_ns") >= F.col("q_start_ns")))
             & (F.col("q_end_ns").isNull() | (F.col("ts_ns") < F.col("q_end_ns")))
             & ((F.col("q_min_severity") <= 0) | (F.col("severity") >= F.col("q_min_severity"))) & has
             & (F.col("q_after_id").isNull() | (F.col("id") > F.col("q_after_id")))
             & (F.col("q_before_id").isNull() | (F.col("id") < F.col("q_before_id")))
             & (~F.col("q_searches") | F.array_contains("found", F.col("q_query"))))
    return rows.join(q, meets).select(F.col("q_query").alias("query"), "id")
