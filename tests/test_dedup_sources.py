"""Dedup cases, namespace gate, raw line files, oversize lines."""

import os

from pyspark.sql import functions as F

from logloom.operators.dedup import dedup_existing, dedup_first, dedup_key
from logloom.schema import LOG_SCHEMA
from logloom.sources.logs import collect_gate, read_raw_lines, split_oversize

T = 1705314600 * 10**9


def logs(spark, rows):
    return spark.createDataFrame([(i, ts, ns, pod, c, sev, msg, None) for i, ts, ns, pod, c, sev, msg in rows],
                                 LOG_SCHEMA)


def test_same_row_twice_is_one(spark):
    df = logs(spark, [(1, T, "ns", "p", "c", 3, "m"), (2, T, "ns", "p", "c", 5, "m")])
    out = dedup_first(df, order="id").collect()
    assert [(r.id, r.severity) for r in out] == [(1, 3)]


def test_near_duplicates_stay(spark):
    base = (1, T, "ns", "p", "c", 3, "m")
    variants = [base, (2, T + 1, "ns", "p", "c", 3, "m"), (3, T, "ns2", "p", "c", 3, "m"),
                (4, T, "ns", "p2", "c", 3, "m"), (5, T, "ns", "p", "c2", 3, "m"), (6, T, "ns", "p", "c", 3, "m2")]
    assert dedup_first(logs(spark, variants), order="id").count() == 6


def test_repair_keeps_smallest_id_and_legacy_rows(spark):
    df = logs(spark, [(3, T, "ns", "p", "c", 3, "m"), (1, T, "ns", "p", "c", 3, "m"), (2, T, "ns", "p", "c", 3, "m"),
                      (4, T, "ns", "p", "c", 3, "other")])
    assert sorted(r.id for r in dedup_existing(df).collect()) == [1, 4]
    legacy = df.withColumn("k", F.when(F.col("id") == 3, F.lit(None)).otherwise(dedup_key(df)))
    kept = dedup_existing(legacy, key_present=F.col("k").isNotNull())
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_gate(spark):
    df = spark.createDataFrame([(n,) for n in ["kube-system", "production", "staging", "default"]], "namespace string")

    def names(**kw):
        return sorted(r.namespace for r in collect_gate(df, **kw).collect())

    assert names() == ["default", "production", "staging"]
    assert names(include=["production", "staging"], exclude=[]) == ["production", "staging"]
    assert names(include=["production", "kube-system"]) == ["production"]
    assert names(include=[], exclude=[]) == ["default", "kube-system", "production", "staging"]


def test_raw_files_and_oversize(spark, tmp_dir):
    d = os.path.join(tmp_dir, "logs", "production", "api-7f9_uid-123", "main")
    os.makedirs(d)
    with open(os.path.join(d, "0.log"), "w") as fh:
        fh.write("2024-01-15T10:30:00Z [INFO] one\n2024-01-15T10:30:01Z two\n" + "x" * 2000 + "\n")
    raw = read_raw_lines(spark, os.path.join(tmp_dir, "logs"))
    rows = raw.orderBy("arrival").collect()
    assert [(r.namespace, r.pod, r.pod_uid, r.container) for r in rows[:1]] == [("production", "api-7f9", "uid-123", "main")]
    assert len(rows) == 3
    ok, bad = split_oversize(raw, max_bytes=1000)
    assert ok.count() == 2 and bad.count() == 1


def test_raw_lines_of_one_container_lie_in_several_files(spark, tmp_dir, monkeypatch):
    from logloom.plans import queries
    from logloom.plans.fixtures import raw_view

    sf = "/root/testdata/sf0.01"
    root = f"{tmp_dir}/raw"
    one = raw_view(spark, sf).withColumns({"namespace": F.lit("live"), "pod": F.lit("p-1"), "container": F.lit("c")})
    monkeypatch.setattr(queries, "raw_view", lambda *_: one)
    monkeypatch.setattr(queries, "_scratch", lambda *_: root)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.QUERIES["read_raw_lines"](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f"{d}/{n}" for d, _, names in os.walk(root) for n in names if n.startswith("part-")]
    assert len(files) == 4  # ranges of the session, where hashing by container made one
    assert {(r.namespace, r.pod, r.pod_uid, r.container) for r in got} == {("live", "p", "u0", "c")}
    want = [r.line for r in one.orderBy("arrival").collect()]
    assert sorted((r.nth, r.line) for r in got) == list(enumerate(want, 1))
