"""What must not grow with the number of containers, queries or copies."""

import os

import pytest
from pyspark.sql import functions as F

T0 = 1704110400 * 10**9
H = 3600 * 10**9
NOW = {"availableNow": True}


def test_idle_timers_share_state_rows(spark, tmp_dir):
    """Many containers have few state rows, and the events of each."""
    from logloom.schema import LOG_SCHEMA
    from logloom.streaming.idle import BUCKETS, idle_events_stream, read_idle_events

    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    n = 2 * BUCKETS
    pods = [f"p{i}" for i in range(n)]
    lines = [(p, T0 + k) for k, p in enumerate(pods)] + [(p, T0 + k) for k, p in enumerate(pods)]     # each twice
    late = [(p, T0 + H + k + k % 2) for k, p in enumerate(pods)]     # in time for every other one only
    for part in (lines, late, [("last", T0 + 9 * H)]):
        spark.createDataFrame([(i, t, "ns", p, "main", 3, "m", None) for i, (p, t) in enumerate(part)],
                              LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = idle_events_stream(s, out, os.path.join(tmp_dir, "ck"), timeout_ns=H, lateness="1 minute", trigger=NOW)
    q.awaitTermination()
    got = {(r.pod, r.last_ts_ns) for r in read_idle_events(spark, out).collect()}
    assert got == {(p, t) for p, t in late} | {(p, t) for k, (p, t) in enumerate(lines[:n]) if k % 2}
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= BUCKETS


@pytest.mark.parametrize("fields", [{}, {"namespace": "ns"}, {"search": "lease"}])
def test_saved_queries_are_the_broadcast_side(spark, tmp_dir, fields):
    """Rows are neither dealt by the queries' few keys nor broadcast, whatever size they seem to have."""
    from logloom.operators.query import LogQuery, match_saved
    from logloom.schema import LOG_SCHEMA

    path = os.path.join(tmp_dir, "rows")
    spark.createDataFrame([(i, T0 + i, "ns", "p", "c", 3, "lease" if i % 2 else "m", None) for i in range(20)], LOG_SCHEMA).write.parquet(path)
    hits = match_saved(spark.read.schema(LOG_SCHEMA).parquet(path), {"a": LogQuery(**fields), "b": LogQuery(after_id=10, **fields)})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    ids = range(1, 20, 2) if "search" in fields else range(20)
    assert sorted((r.query, r.id) for r in hits.collect()) == [("a", i) for i in ids] + [("b", i) for i in ids if i > 10]


def test_json_and_logfmt_steps_are_not_copied(spark):
    """The staged steps give what the single expressions give, and stay one of each in the plan."""
    from logloom.functions.jsonattrs import json_entries
    from logloom.functions.logfmt import logfmt_fields
    from logloom.functions.severity import severity_from_fields
    from logloom.operators.parse import with_json_entries, with_logfmt_fields

    bodies = ['{"level":"warn","a":{"b":1,"b":2},"n":1.50}', '{"lvl":"x"} y', "level=info k= level=error", "plain", "", None, "{", 'a="b\\"c" a=2']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string").repartition(2)
    rows = with_logfmt_fields(with_json_entries(df, "body", "entries"), "body", "pairs")
    severity = severity_from_fields(F.map_from_entries("pairs"))
    got = rows.withColumn("severity", severity)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 4     # three groups, the keys tested once
    want = df.withColumn("entries", json_entries(F.col("body"))).withColumn(
        "pairs", F.when(~F.col("body").startswith("{"), logfmt_fields(F.col("body")))).withColumn("severity", severity)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_merge_without_their_rows(spark):
    """Several appends' blocks of a range become one, sorted, in one shuffle and with no row per occurrence."""
    from logloom.operators.postings import IDS_PER_BLOCK, merged_blocks, occurrences, to_blocks

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int"))
    found = spark.range(-3 * IDS_PER_BLOCK, 3 * IDS_PER_BLOCK, 7).select(
        F.concat(F.lit("t"), (F.col("id") % 3 + 3).cast("string")).alias("term"), "id", F.explode(F.sequence(F.lit(0), F.col("id") % 2 + 2)).alias("pos"), day.alias("log_date"))
    appends = [to_blocks(found.where(F.pmod(F.floor(F.col("id") / 21), F.lit(3)) == k)) for k in range(3)]
    blocks = appends[0].unionByName(appends[1]).unionByName(appends[2]).localCheckpoint()
    merged = merged_blocks(blocks)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    got = sorted(map(str, merged.collect()))
    assert got == sorted(map(str, to_blocks(found).collect())) and len(got) < blocks.count()
    cols = ["term", "id", "pos", "log_date"]
    assert sorted(map(str, occurrences(merged).select(cols).collect())) == sorted(map(str, found.select(cols).collect()))


def test_stems_stay_in_arrow():
    """Null and empty rows, null tokens and slices of a batch; tokens are not taken to Python one by one."""
    import pyarrow as pa

    from logloom.functions.stem import _stem_arrays

    rows = [["x"], ["running", "cache"], None, [], ["running", None], ["Zahl"]]
    whole = pa.array(rows, pa.list_(pa.string()))
    want = [["x"], ["run", "cach"], None, [], ["run", None], ["Zahl"]]
    got = _stem_arrays(whole)
    assert got.type == pa.list_(pa.string()) and got.to_pylist() == want
    assert _stem_arrays(whole.slice(1, 4)).to_pylist() == want[1:5]
    assert _stem_arrays(whole.slice(2, 2)).to_pylist() == want[2:4] and _stem_arrays(whole.slice(0, 0)).to_pylist() == []


def test_a_batch_of_one_file_is_many_tasks(spark, tmp_dir):
    """The lines of one file are parsed by as many tasks as shuffles have."""
    from pyspark.sql import SparkSession

    from logloom.sources.logs import read_logs
    from logloom.streaming import ingest

    src, table = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "logs")
    spark.createDataFrame([(i, "ns", "p", "u", "c", f"2024-01-15T10:30:00Z level=info msg=m{i}", 0) for i in range(400)],
                          ingest.RAW_STREAM_SCHEMA).coalesce(1).write.parquet(src)
    seen, parse = [], ingest._entries
    ingest._entries = lambda batch: seen.append(batch.rdd.getNumPartitions()) or parse(batch)
    try:
        ingest.ingest_stream(spark, ingest.stream_raw_lines(spark, src), table, os.path.join(tmp_dir, "ck"), trigger=NOW).awaitTermination()
    finally:
        ingest._entries = parse
    assert seen == [int(SparkSession.getActiveSession().conf.get("spark.sql.shuffle.partitions"))]
    assert [(r.id, r.message) for r in read_logs(spark, table).orderBy("id").collect()] == [(i + 1, f"m{i}") for i in range(400)]
