"""JSON object lines -> scalar attributes, with Go-compatible number text.

The whole message must be one JSON object starting at its first character.
A bare ``from_json`` accepts trailing text after the object, so the message
is parsed wrapped in ``[ ]`` and in ``{"v": }``: text that closes one wrap
does not close the other.  Values are read as VARIANT so their JSON type can
be tested: strings and booleans become text, numbers follow the number rule,
arrays, objects, nulls and empty strings are dropped.  A number beyond the
range of a double is no JSON, nor is a line nested in more than 1000 levels
(what Spark's JSON parser reads and writes).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions.attrs import last_wins
from logloom.functions.bind import let

_BIG = 1 << 30
_INT64_BOUND = 9.223372036854775808e18


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_object(message: Column) -> Column:
    """Message -> array<map<string,variant>> (one element when the message is
    exactly one JSON object); NULL unless it starts with ``{``."""
    listed = F.concat(F.lit("["), message, F.lit("]"))
    # text after the object can only hide where it closes the list
    held = F.from_json(F.concat(F.lit('{"v":'), message, F.lit("}")), "map<string,map<string,string>>", _STRICT)
    one = (F.size(held) == 1) & (F.element_at(F.map_keys(held), 1) == "v") & F.element_at(F.map_values(held), 1).isNotNull()
    whole = F.when(message.rlike(r"\}\s*\]"), F.coalesce(one, F.lit(False))).otherwise(F.lit(True))
    # VARIANT refuses an object inside that repeats a key: such lines are read
    # as text, with a mark on every string
    typed = F.from_json(listed, "array<map<string,variant>>", _STRICT)
    plain = F.from_json(_marked(listed), "array<map<string,string>>", _STRICT)
    marked = F.transform(plain, lambda m: F.map_from_entries(last_wins(F.transform(
        F.map_entries(m), lambda e: F.struct(e["key"].substr(F.lit(2), F.lit(_BIG)).alias("key"),
                                             _unmarked(e["value"]).alias("value"))))))
    parsed = F.when(message.startswith("{") & whole, F.coalesce(typed, marked))
    return F.when(message.rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{300}"), _finite(parsed)).otherwise(parsed)


def _finite(parsed: Column) -> Column:
    """NULL if a member is a number beyond the range of a double."""
    def beyond(x: Column) -> Column:
        number = F.schema_of_variant(x["value"]).isin("DOUBLE", "FLOAT")
        return F.coalesce(number & (F.abs(F.try_variant_get(x["value"], "$", "double")) == F.lit(float("inf"))), F.lit(False))
    return F.filter(parsed, lambda m: ~F.exists(F.map_entries(m), beyond))


def _marked(json: Column) -> Column:
    """The same JSON with a ``~`` before every key and string.  Escaped
    backslashes and quotes are respelled first, so that every quote left opens
    or closes a string."""
    spelled = F.regexp_replace(F.regexp_replace(json, r"\\\\", r"\\u005c"), r'\\"', r"\\u0022")
    return F.regexp_replace(spelled, '"([^"]*+)"', '"~$1"')


def _unmarked(text: Column) -> Column:
    """Text of a marked member -> VARIANT; arrays and objects become null."""
    string = F.to_json(F.array(text.substr(F.lit(2), F.lit(_BIG))))
    plain = F.try_parse_json(F.when(text.startswith("~"), string.substr(F.lit(2), F.length(string) - 2))
                             .when(text.rlike(r"^[{\[]"), F.lit("null")).otherwise(text))
    return F.when(text.startswith('"'), F.lit(float("inf")).cast("variant")).otherwise(plain)  # a number read as infinite


def object_members(parsed: Column) -> Column:
    """Parsed object -> array<struct<key, value: variant>>, NULL if not one object."""
    return F.when(F.size(parsed) == 1, F.map_entries(F.element_at(parsed, 1)))


def typed_members(members: Column) -> Column:
    """Members (unique keys) -> array<struct<key, t, value>>, ``t`` the JSON
    type and ``value`` the text of a scalar (NULL for others)."""
    def conv(x: Column) -> Column:
        return let(F.schema_of_variant(x["value"]), lambda t: F.struct(
            x["key"].alias("key"), t.alias("t"),
            F.when(t.isin("STRING", "BOOLEAN"), F.try_variant_get(x["value"], "$", "string"))
            .when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
                  number_text(F.try_variant_get(x["value"], "$", "double"))).alias("value")))
    return F.transform(members, conv)


def json_entries(message: Column) -> Column:
    """All steps at once (for tests and single-column use)."""
    return typed_members(last_wins(object_members(parse_object(message))))


def number_text(d: Column) -> Column:
    """JSON number read as a double -> text: integral values in int64 range
    print as integers, all others as Go's shortest ``%g``."""
    return let(d, lambda v: F.when((F.floor(v) == v) & (v >= F.lit(-_INT64_BOUND)) & (v < F.lit(_INT64_BOUND)),
                                   v.cast("long").cast("string")).otherwise(go_g(v)))


def go_g(d: Column) -> Column:
    """Go's shortest ``%g``: exponent form (``1.5e-05``, ``1.2345675e+06``)
    when the decimal exponent is < -4 or >= 6, else plain decimal.  Digits
    come from the JVM's shortest text of the double."""
    return let(F.abs(d).cast("string"), lambda s: _go_g_text(d, s))


def _go_g_text(d: Column, s: Column) -> Column:
    ip = F.split_part(s, F.lit("."), F.lit(1))
    fp = F.split_part(s, F.lit("."), F.lit(2))
    sci = F.contains(s, F.lit("E"))
    digits = F.regexp_replace(
        F.when(sci, F.replace(F.split_part(s, F.lit("E"), F.lit(1)), F.lit("."), F.lit("")))
        .when(ip != "0", F.concat(ip, fp))
        .otherwise(F.regexp_replace(fp, "^0+", "")), "0+$", "")
    exp10 = (F.when(sci, F.split_part(s, F.lit("E"), F.lit(2)).cast("int"))
             .when(ip != "0", F.length(ip) - 1)
             .otherwise(-(F.length(fp) - F.length(F.regexp_replace(fp, "^0+", "")) + 1)))

    def fmt(r: Column) -> Column:
        dg, ex = r["dg"], r["ex"]
        tail = dg.substr(F.lit(2), F.lit(_BIG))
        e_form = F.concat(F.substring(dg, 1, 1),
                          F.when(F.length(dg) > 1, F.concat(F.lit("."), tail)).otherwise(F.lit("")),
                          F.lit("e"), F.when(ex < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.lpad(F.abs(ex).cast("string"), 2, "0"))
        head = dg.substr(F.lit(1), ex + 1)
        f_pos = F.concat(head, F.repeat(F.lit("0"), F.greatest(ex + 1 - F.length(head), F.lit(0))),
                         F.when(F.length(dg) > ex + 1, F.concat(F.lit("."), dg.substr(ex + 2, F.lit(_BIG))))
                         .otherwise(F.lit("")))
        f_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -ex - 1), dg)
        return F.when((ex < -4) | (ex >= 6), e_form).when(ex >= 0, f_pos).otherwise(f_neg)

    body = F.element_at(F.transform(F.array(F.struct(digits.alias("dg"), exp10.alias("ex"))), fmt), 1)
    return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), body)


def json_string_fields(entries: Column) -> Column:
    """Map of the members whose JSON type is string (severity keys only count
    when they hold a string)."""
    return F.map_from_entries(F.transform(F.filter(entries, lambda x: x["t"] == "STRING"),
                                          lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def json_value_entries(entries: Column) -> Column:
    """Scalar members with non-empty text as (key, value) entries."""
    kept = F.filter(entries, lambda x: x["value"].isNotNull() & (x["value"] != ""))
    return F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
