"""Repair of a stored table: repeats and missing index, only touched files."""

import os

import pytest
from pyspark.sql import functions as F

from logloom.operators.query import LogQuery, apply_query, match_saved
from logloom.schema import LOG_SCHEMA
from logloom.sinks.repair import repair_table
from logloom.sinks.table import write_log_table
from logloom.sources.logs import read_logs, read_postings
from tests.test_store import H, T0, counted_fs

DAY = 24 * H


def write(spark, path, specs, post=None, bare=False):
    df = spark.createDataFrame([(i, ts, "ns", "pod", "main", 3, msg, None) for i, ts, msg in specs], LOG_SCHEMA)
    if bare:
        df = df.withColumn("terms", F.lit(None).cast("array<string>"))
    write_log_table(df, path, postings_path=post)


def data_files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_appends" not in d}


def planted(spark, root):
    path, post = f"{root}/logs", f"{root}/post"
    write(spark, path, [(1, T0, "same words"), (2, T0 + DAY, "other"), (3, T0 + 2 * DAY, "third day")], post)
    write(spark, path, [(4, T0, "same words"), (5, T0, "same word"), (6, T0 + 2 * DAY + 1, "third day")], post)   # 4 repeats 1
    write(spark, path, [(7, T0 + 3 * DAY, "indexed late")], post, bare=True)
    return path, post


def state(spark, path, post):
    rows = sorted((r.id, tuple(r.terms)) for r in read_logs(spark, path).collect())
    lists = sorted((r.id, r.pos, r.term) for r in read_postings(spark, post).collect())
    assert lists == sorted((i, k, t) for i, ts in rows for k, t in enumerate(ts))
    return [i for i, _ in rows]


def test_repair_touches_only_files_with_faults(spark, tmp_dir):
    path, post = planted(spark, tmp_dir)
    before = data_files(path)
    assert repair_table(spark, path, f"{tmp_dir}/stage", post) == 2
    after = data_files(path)
    gone = {f.split("log_date=")[1][:10] for f in before - after}
    assert gone == {"2024-01-01", "2024-01-04"} and len(before - after) == 2 == len(after - before)
    assert state(spark, path, post) == [1, 2, 3, 5, 6, 7]
    assert repair_table(spark, path, f"{tmp_dir}/stage", post) == 0 and data_files(path) == after


@pytest.mark.parametrize("at", [2, 4, 7, 10])
def test_repair_killed_and_finished_beside_an_append(spark, tmp_dir, monkeypatch, at):
    path, post = planted(spark, tmp_dir)
    with monkeypatch.context() as m:
        counted_fs(m, at, "before")
        with pytest.raises(OSError):
            repair_table(spark, path, f"{tmp_dir}/stage", post)
    write(spark, path, [(8, T0 + 5, "appended"), (9, T0 + 3 * DAY + 1, "appended too")], post)
    assert repair_table(spark, path, f"{tmp_dir}/stage", post) == 2
    assert state(spark, path, post) == [1, 2, 3, 5, 6, 7, 8, 9]


def test_saved_queries_in_one_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    df = spark.createDataFrame(
        [(i, T0 + i * H, ("a", "b", "c")[i % 3], f"p{i % 4}", "main", i % 6, f"alpha {'beta' if i % 2 else 'gamma'} {i}",
          {"k": str(i % 5)} if i % 4 else None) for i in range(1, 61)], LOG_SCHEMA)
    write_log_table(df, path)
    queries = {"all": LogQuery(), "a": LogQuery(namespace="a"), "a p1": LogQuery(namespace="a", pod="p1"), "p1": LogQuery(pod="p1"),
               "none": LogQuery(namespace="zzz"), "sev": LogQuery(min_severity=5, container="main"), "attr": LogQuery(attributes={"k": "3"}),
               "time": LogQuery(start_ns=T0 + 5 * H, end_ns=T0 + 9 * H), "ids": LogQuery(after_id=10, before_id=15),
               "word": LogQuery(search="beta"), "word b": LogQuery(search="gamma", namespace="b", min_severity=2), "nothing": LogQuery(search="!!!")}
    for logs in (read_logs(spark, path), df):
        hits = match_saved(logs, queries)
        got = sorted((r.query, r.id) for r in hits.collect())
        assert got == sorted((n, r.id) for n, q in queries.items() for r in apply_query(logs, q).select("id").collect())
    plan = match_saved(read_logs(spark, path), queries)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == 1
    assert match_saved(df, {}).isEmpty()
