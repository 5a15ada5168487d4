"""Parser cases (line -> time, severity, message, attributes)."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logloom.functions.attrs import attrs_text
from logloom.functions.logfmt import logfmt_fields
from logloom.functions.timestamps import format_ts, ns_to_date, rfc3339_ns
from logloom.operators.parse import parse_lines, to_log_entry

TS = "2024-01-15T10:30:00Z "
TS_NS = 1705314600 * 10**9
INGEST = 42

CASES = [
    # line, severity, message, attributes text
    (TS + "kettle is warm", 0, "kettle is warm", ""),
    ("2024-01-15T10:30:00.000000001Z kettle is warm", 0, "kettle is warm", ""),
    (TS + "[INFO] harbour opened at dawn", 3, "[INFO] harbour opened at dawn", ""),
    (TS + '{"severity":"WARN","message":"tide is high"}', 4, "tide is high", "severity=WARN"),
    (TS + "{almost an object}", 0, "{almost an object}", ""),
    (TS + "[WARNING] ice on deck", 4, "[WARNING] ice on deck", ""),
    (TS + "level=PANIC msg=flooded", 6, "flooded", "level=PANIC"),
    (TS + '{"level":"INFO","traceId":"t-77","msg":"docked"}', 3, "docked", "level=INFO;trace_id=t-77"),
    (TS + '{"level":"INFO","user_id":9001,"msg":"docked"}', 3, "docked", "level=INFO;user_id=9001"),
    (TS + '{"level":"INFO","berth":"north","tons":880}', 3,
     '{"level":"INFO","berth":"north","tons":880}', "berth=north;level=INFO;tons=880"),
    (TS + 'level=info msg="pilot \\"ada\\" aboard"', 3, 'pilot "ada" aboard', "level=info"),
    (TS + 'level=error err="anchor dragged"', 5, "anchor dragged", "level=error"),
    (TS + '{"level":"INFO","msg":"docked","crew":12,"moored":true,"draught":7.25,"hold":{"a":1},"bays":[4,5]}',
     3, "docked", "crew=12;draught=7.25;level=INFO;moored=true"),
    # logfmt goes before the bracket pattern; spellings are whole upper or lower case
    (TS + "[ERROR] winch jammed deck=2", 0, "[ERROR] winch jammed deck=2", "deck=2"),
    (TS + '{"level":"Info"}', 0, '{"level":"Info"}', "level=Info"),
    (TS + '{"q":1} and more', 0, '{"q":1} and more', ""),
    (TS + 'p="u"q=4', 0, 'p="u"q=4', "p=u;q=4"),
    (TS + '{"w":1,"w":2}', 0, '{"w":1,"w":2}', "w=2"),
    (TS + '{"in":{"level":"ERROR"}}', 5, '{"in":{"level":"ERROR"}}', ""),
    (TS + "ERROR: mast broke", 5, "ERROR: mast broke", ""),
    (TS + "a sail tore today (error)", 0, "a sail tore today (error)", ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, line string")
    out = parse_lines(df, ingest_ns=INGEST).select("i", "ts_ns", "severity", "message",
                                                   attrs_text("attributes").alias("a"))
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(parsed, i):
    line, sev, msg, attrs = CASES[i]
    r = parsed[i]
    assert (r.severity, r.message, r.a) == (sev, msg, attrs), line


def test_nanoseconds_and_zone(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:00.123456789Z x",), ("2024-01-15T12:30:00.5+02:00 x",),
                                ("2024-01-15T10:30:00.1234567891Z x",), ("no time here",),
                                ("2024-02-30T10:30:00Z bad day",)], "line string")
    got = [r.ts_ns for r in parse_lines(df, ingest_ns=INGEST).collect()]
    assert got == [TS_NS + 123456789, TS_NS + 500000000, TS_NS + 123456789, INGEST, INGEST]


def test_number_text(spark):
    df = spark.createDataFrame(
        [(TS + '{"a":1.5e-7,"b":1234567.5,"c":0.00015,"d":1e21,"e":1.0,"f":-2.5,"g":123456.7,"h":12345678901234567890}',)],
        "line string")
    r = parse_lines(df, ingest_ns=0).select(attrs_text("attributes").alias("a")).first()
    assert r.a == "a=1.5e-07;b=1.2345675e+06;c=0.00015;d=1e+21;e=1;f=-2.5;g=123456.7;h=1.2345678901234567e+19"


def test_attribute_cap_keeps_level(spark):
    fields = ",".join(f'"bay{i:02d}":"cargo {i}"' for i in range(30))
    df = spark.createDataFrame([(TS + '{"level":"INFO","msg":"loaded",' + fields + "}",)], "line string")
    r = parse_lines(df, ingest_ns=0).first()
    assert r.message == "loaded" and r.severity == 3
    assert len(r.attributes) <= 20 and r.attributes["level"] == "INFO"


def test_pod_uid_overrides(spark):
    df = spark.createDataFrame([(TS + "pod_uid=fake x=1", "real")], "line string, pod_uid string")
    r = to_log_entry(parse_lines(df, ingest_ns=0)).first()
    assert r.attributes == {"pod_uid": "real", "x": "1"}


LOGFMT = [
    ("port=west", {"port": "west"}),
    ("x=9 y=8 z=7", {"x": "9", "y": "8", "z": "7"}),
    ('note="two masts"', {"note": "two masts"}),
    ('lvl=warn note="two masts" tons=15', {"lvl": "warn", "note": "two masts", "tons": "15"}),
    ('note="the \\"old\\" pier"', {"note": 'the "old" pier'}),
    ('dir="Z:\\\\maps\\\\sea"', {"dir": "Z:\\maps\\sea"}),
    ("blank=", {"blank": ""}),
    ("berth_no=b3 gate.id=44", {"berth_no": "b3", "gate.id": "44"}),
    ("x-dock-ref=q1", {"x-dock-ref": "q1"}),
    (" \t p=1 \t  q=2   ", {"p": "1", "q": "2"}),
    ("no pairs in here", {}),
    ('note="upper\\nlower"', {"note": "upper\nlower"}),
    ('p=1 p=2 q="left open \\', {"p": "2", "q": "left open \\"}),
]


def test_logfmt_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(LOGFMT)], "i int, s string")
    got = {r.i: {e.key: e.value for e in r.f} for r in df.select("i", logfmt_fields(F.col("s")).alias("f")).collect()}
    for i, (_, want) in enumerate(LOGFMT):
        assert got[i] == want, LOGFMT[i][0]


def test_parser_is_total_on_real_text(spark):
    """Every line of the documents, pages and conversations (junk, markup,
    secrets, four languages) parses without error, keeps its text when it
    is not structured, and never yields more than 20 attributes."""
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select(F.explode(F.split("html", "\n")).alias("line"))
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(F.col("text").alias("line"))
    lines = docs.unionByName(pages).unionByName(conv).where(F.col("line").isNotNull())
    lines = lines.withColumn("pfx", F.when(F.rand(7) < 0.5, F.lit(TS)).otherwise(F.lit(""))) \
        .withColumn("line", F.concat("pfx", "line")).drop("pfx")
    out = parse_lines(lines, ingest_ns=INGEST, keep_line=True)
    r = out.agg(F.count("*").alias("n"), F.max(F.size("attributes")).alias("max_attrs"),
                F.sum(F.when(F.col("message").isNull() | F.col("ts_ns").isNull(), 1).otherwise(0)).alias("nulls"),
                F.sum(F.when((F.col("attributes").isNull()) & (F.col("ts_ns") == INGEST) & (F.col("message") != F.col("line")), 1)
                      .otherwise(0)).alias("lost")).first()
    assert r.n > 100 and r.nulls == 0 and r.lost == 0 and (r.max_attrs or 0) <= 20


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80), min_size=1, max_size=20))
def test_parser_total_on_random_text(spark, texts):
    df = spark.createDataFrame([(TS + t,) for t in texts] + [(t,) for t in texts], "line string")
    rows = parse_lines(df, ingest_ns=INGEST).collect()
    assert len(rows) == 2 * len(texts) and all(r.message is not None for r in rows)


@pytest.mark.parametrize("line,ts,message", [
    ("9999-12-31T23:59:59Z x", None, "9999-12-31T23:59:59Z x"),
    ("2262-04-11T23:47:16.854775807Z ok", 2**63 - 1, "ok"),
    ("2262-04-11T23:47:16.854775808Z over", None, "2262-04-11T23:47:16.854775808Z over"),
    ("1677-01-01T00:00:00Z under", None, "1677-01-01T00:00:00Z under"),
    ("2039-01-01T00:00:00Z later", 2177452800 * 10**9, "later"),
])
def test_times_beyond_the_range_are_text(spark, line, ts, message):
    df = spark.createDataFrame([(line,)], "line string")
    r = parse_lines(df, ingest_ns=7).select("ts_ns", "message", ns_to_date("ts_ns").alias("d"),
                                            format_ts("ts_ns").alias("f"), rfc3339_ns("ts_ns").alias("z")).first()
    assert (r.ts_ns, r.message) == (7 if ts is None else ts, message)
    assert r.z[:10] == r.f[:10] == str(r.d)


@pytest.mark.parametrize("line,attrs", [
    ('{"q":7}] tail', None), ('{"q":7}} tail', None), ('{"q":7},"z":{"w":1}', None), ('{"q":7},{"w":1}', None),
    ('{"q":7}', {"q": "7"}), ('{"x":1e400}', None), ('{"x":-1e999,"y":"kept?"}', None),
    ('{"level":"ERROR","in":{"p":1,"p":2}}', {"level": "ERROR"}),
    ('{"in":{"p":1,"p":2},"b":"1e5","o":"{x}","t":"true","c":1e5,"d":"x\\\\","~k":"~v"}',
     {"b": "1e5", "o": "{x}", "t": "true", "c": "100000", "d": "x\\", "~k": "~v"}),
    ('{"in":{"p":1,"p":2},"\\u0061":"\\u00e9\\t\\"q\\"","n":null,"l":["1"]}', {"a": '\u00e9\t"q"'}),
    ('{"in":{"p":1,"p":2},"x":1e400}', None), ("{'in':{'p':1,'p':2}}", None), ('{"in":{"p":1,"p":2}} "b"', None),
    ('{"n":5,"s":"a \\"b\\" [1]","t":true,"e":"","in":{"p":1,"p":2},"n":6}', {"n": "6", "s": 'a "b" [1]', "t": "true"}),
])
def test_json_wraps_numbers_and_inner_repeats(spark, line, attrs):
    r = parse_lines(spark.createDataFrame([(line,)], "line string"), ingest_ns=7).first()
    assert r.attributes == attrs


def test_a_long_line_of_pairs_parses_in_seconds(spark):
    import time

    line = "level=info " + " ".join(f"key{i % 60000}=value{i}" for i in range(64000))
    assert len(line) > 1 << 20
    t0 = time.time()
    r = parse_lines(spark.createDataFrame([(line,)], "line string"), ingest_ns=7).first()
    assert r.severity == 3 and len(r.attributes) == 20 and time.time() - t0 < 60
