"""Attribute maps: alias normalisation, the 20-entry cap, pod uid, text form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions.bind import let

# Fixed values that must equal the reference: canonical attribute names and
# their aliases, in the order in which the first present alias wins.
FIELD_ALIASES = {
    "msg": ["msg", "message", "error", "err"],
    "trace_id": ["trace_id", "traceId", "trace-id", "traceID"],
    "span_id": ["span_id", "spanId", "span-id", "spanID"],
    "request_id": ["request_id", "requestId", "request-id", "requestID", "req_id"],
    "caller": ["caller", "source", "file", "location"],
    "service": ["service", "app", "application"],
    "user_id": ["user_id", "userId", "user"],
}
# Fixed value: at most this many attributes are kept per line (msg included).
MAX_ATTRIBUTES = 20
SEVERITY_KEYS = ["level", "severity", "lvl"]

# up to so many entries a comparison of all is cheaper than sorting
_FEW = 32

_ALL_ALIASES = [a for names in FIELD_ALIASES.values() for a in names]


def last_wins(entries: Column) -> Column:
    """Keep, for every key, only its last entry (JSON and logfmt semantics).

    Few entries are compared with those after them.  More are sorted by key
    and position, the last of each run of equal keys stays, and the positions
    that stay are sorted back: n log n for the longest line."""
    def compared(arr: Column) -> Column:
        return F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, i + 2, F.lit(_FEW)), lambda y: y["key"] == x["key"]))

    def keep(arr: Column) -> Column:
        keyed = F.array_sort(F.transform(arr, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"))))
        last = let(keyed, lambda run: F.filter(run, lambda x, i: ~F.coalesce(
            F.try_element_at(run, i + 2)["key"] == x["key"], F.lit(False))))
        at = F.array_sort(F.transform(last, lambda x: x["at"]))
        return F.transform(at, lambda i: F.element_at(arr, i + 1))
    return F.when(F.size(entries) <= _FEW, let(entries, compared)).when(entries.isNotNull(), let(entries, keep))


def normalize_entries(entries: Column) -> Column:
    return let(entries, _normalize_bound)


def _normalize_bound(entries: Column) -> Column:
    """Unique-key (key, value) entries with non-empty values -> capped, alias
    normalised entries.  Rank: canonical names in table order, then the
    severity keys, then every other key in order of appearance."""
    return let(F.map_from_entries(entries), lambda lookup: _normalize_with(entries, lookup))


def _normalize_with(entries: Column, lookup: Column) -> Column:
    canon = [
        F.struct(F.lit(c).alias("key"),
                 F.coalesce(*[F.try_element_at(lookup, F.lit(a)) for a in aliases]).alias("value"))
        for c, aliases in FIELD_ALIASES.items()
    ]
    canon_arr = F.filter(F.array(*canon), lambda x: x["value"].isNotNull())
    alias_lit = F.array(*[F.lit(a) for a in _ALL_ALIASES])
    sev_lit = F.array(*[F.lit(a) for a in SEVERITY_KEYS])
    rest = F.filter(entries, lambda x: ~F.array_contains(alias_lit, x["key"]))
    sev_first = F.filter(rest, lambda x: F.array_contains(sev_lit, x["key"]))
    others = F.filter(rest, lambda x: ~F.array_contains(sev_lit, x["key"]))
    return F.slice(F.concat(canon_arr, sev_first, others), 1, MAX_ATTRIBUTES)


def entries_to_map(entries: Column) -> Column:
    """Entries -> map, NULL when empty (an empty map is never stored)."""
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def with_pod_uid(attrs: Column, pod_uid: Column) -> Column:
    """Attributes always carry the pod uid (overwriting one from the line)."""
    base = F.coalesce(F.map_filter(attrs, lambda k, v: k != F.lit("pod_uid")),
                      F.create_map().cast("map<string,string>"))
    return F.map_concat(base, F.create_map(F.lit("pod_uid"), pod_uid))


def attrs_text(attrs: Column | str) -> Column:
    """Map -> ``k=v;k=v`` sorted by key ('' for NULL); stable for comparison."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    kv = F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(F.array_sort(kv), ";"), F.lit(""))


def attr_equals(attrs: Column | str, key: str, value: str) -> Column:
    """Exact attribute test; a missing key or NULL map never matches.
    Dotted keys are plain keys (no JSON path interpretation)."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.coalesce(F.try_element_at(attrs, F.lit(key)) == F.lit(value), F.lit(False))
