"""Timestamp prefix split (nanosecond precision) and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions.bind import let

# The first blank-free token of a line, when it is an RFC3339 time: groups
# date-time, fraction (any length; digits past the ninth are ignored), zone.
TS_TOKEN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})$"
_NS_PER_S = 1_000_000_000
_NS_PER_DAY = 86_400 * _NS_PER_S


def floor_div(c: Column, n: int) -> Column:
    """Exact integer floor division of a BIGINT (no detour through DOUBLE,
    which cannot hold nanosecond times exactly)."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def token_ns(tok: Column) -> Column:
    """Nanoseconds of an RFC3339 token, NULL when it is not a valid instant."""
    dt = F.regexp_extract(tok, TS_TOKEN, 1)
    frac = F.regexp_extract(tok, TS_TOKEN, 2)
    zone = F.regexp_extract(tok, TS_TOKEN, 3)
    secs = F.unix_seconds(F.try_to_timestamp(F.concat(dt, zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    nanos = F.rpad(F.substring(frac, 1, 9), 9, "0").cast("long")
    # beyond 1677..2262 nanoseconds do not fit a BIGINT: not a timestamp
    return F.when(F.length(dt) > 0, F.try_add(F.try_multiply(secs, F.lit(_NS_PER_S)), nanos))


def prefix_ns(line: Column) -> Column:
    """Nanoseconds of the line's timestamp prefix: the text before the first
    blank, at least 20 bytes, an RFC3339 time.  NULL when there is none."""
    first = F.substring_index(line, " ", 1)
    return F.when(F.contains(line, F.lit(" ")) & (F.octet_length(first) >= 20), token_ns(first))


def message_after_prefix(line: Column, ns: Column) -> Column:
    """The text after the prefix when ``ns`` (from :func:`prefix_ns`) is set,
    else the whole line."""
    first = F.substring_index(line, " ", 1)
    return F.when(ns.isNotNull(), line.substr(F.length(first) + 2, F.lit(1 << 30))).otherwise(line)


def split_timestamp(line: Column | str, ingest_ns: Column | int) -> Column:
    """struct(ts_ns, message).  Without a valid prefix the message is the
    whole line and the time is the ingest time (never a clock read)."""
    line = F.col(line) if isinstance(line, str) else line
    ingest = ingest_ns if isinstance(ingest_ns, Column) else F.lit(int(ingest_ns))
    return let(prefix_ns(line), lambda n: F.struct(
        F.coalesce(n, ingest.cast("long")).alias("ts_ns"), message_after_prefix(line, n).alias("message")))


def ns_to_ts(ts_ns: Column | str) -> Column:
    """BIGINT nanoseconds -> TIMESTAMP (microsecond precision)."""
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.timestamp_micros(floor_div(ts_ns, 1000))


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_wallclock(ts_ns: Column | str) -> Column:
    """BIGINT ns -> TIMESTAMP_NTZ holding the UTC wall clock (microseconds):
    formatting and dates built on it do not depend on the session time zone."""
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    days = floor_div(ts_ns, _NS_PER_DAY)
    rest = F.pmod(ts_ns, F.lit(_NS_PER_DAY))  # of the day: its seconds fit an INT
    secs = floor_div(rest, _NS_PER_S)
    micros = floor_div(F.pmod(rest, F.lit(_NS_PER_S)), 1000)
    day = F.timestamp_add("DAY", days.cast("int"), F.expr(_EPOCH_NTZ))
    return F.timestamp_add("MICROSECOND", micros.cast("int"), F.timestamp_add("SECOND", secs.cast("int"), day))


def ntz_micros(ts_ntz: Column | str) -> Column:
    """TIMESTAMP_NTZ (a UTC wall clock) -> Unix microseconds, zone-free."""
    ts_ntz = F.col(ts_ntz) if isinstance(ts_ntz, str) else ts_ntz
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts_ntz)


def ns_to_date(ts_ns: Column | str) -> Column:
    """UTC day of a nanosecond time, the partition column of the log table."""
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts_ns, _NS_PER_DAY).cast("int"))


def format_ts(ts_ns: Column | str) -> Column:
    """Display form ``yyyy-MM-dd HH:mm:ss.SSS`` (UTC session)."""
    return F.date_format(utc_wallclock(ts_ns), "yyyy-MM-dd HH:mm:ss.SSS")


def rfc3339_ns(ts_ns: Column | str) -> Column:
    """RFC3339 text with nine fraction digits, UTC."""
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    secs = floor_div(ts_ns, _NS_PER_S)
    frac = (ts_ns - secs * F.lit(_NS_PER_S)).cast("string")
    return F.concat(F.date_format(utc_wallclock(secs * F.lit(_NS_PER_S)), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.lit("."), F.lpad(frac, 9, "0"), F.lit("Z"))
