"""Tail and ingest streams: resume from a checkpoint, filters, replay."""

import os

import pytest
from pyspark.sql import functions as F

from logloom.operators.query import LogQuery
from logloom.schema import LOG_SCHEMA
from logloom.sinks.table import write_log_table
from logloom.sources.logs import read_logs, read_structured
from logloom.sinks.unique import read_unique
from logloom.streaming import tail

T0 = 1704110400 * 10**9


def rows(spark, start, n, sev=5):
    return spark.createDataFrame([(i, T0 + i, "ns", "p", "c", sev if i % 2 else 2, f"m{i}", None)
                                  for i in range(start, start + n)], LOG_SCHEMA)


NOW = {"availableNow": True}


def test_tail_resumes_and_filters(spark, tmp_dir):
    table, out, ck = (os.path.join(tmp_dir, x) for x in ("logs", "out", "ck"))

    def run():
        stream = tail.tail_stream(spark, table, LogQuery(min_severity=4)).drop("terms", "log_date")
        tail.tail_run(stream, out, ck, NOW).awaitTermination()
        return sorted(r.id for r in read_unique(spark, out).collect())

    write_log_table(rows(spark, 1, 20), table)
    assert run() == [i for i in range(1, 21) if i % 2]
    write_log_table(rows(spark, 21, 10), table)               # new rows arrive later
    assert run() == [i for i in range(1, 31) if i % 2]           # each id once, nothing re-read


def test_tail_shows_no_id_again_after_retention(spark, tmp_dir):
    from logloom.sinks.retention import apply_retention

    table, out, ck = (os.path.join(tmp_dir, x) for x in ("logs", "out", "ck"))

    def run():
        tail.tail_run(tail.tail_source(spark, table, max_files=1).drop("terms", "log_date"), out, ck, NOW).awaitTermination()
        got = [r.id for r in read_unique(spark, out).collect()]
        assert len(got) == len(set(got))
        return sorted(got)

    write_log_table(rows(spark, 1, 40), table, partitions=4)
    assert run() == list(range(1, 41))
    assert apply_retention(spark, table, T0 + 11, os.path.join(tmp_dir, "stage")) == 10   # ids 1..10
    write_log_table(rows(spark, 41, 5), table)
    assert sorted(r.id for r in read_logs(spark, table).collect()) == list(range(11, 46))
    assert run() == list(range(1, 46))        # the rewritten day gives nothing twice


def test_tail_meets_rewritten_rows_it_had_not_read(spark, tmp_dir):
    from logloom.sinks.retention import apply_retention

    table, out, ck = (os.path.join(tmp_dir, x) for x in ("logs", "out", "ck"))
    write_log_table(rows(spark, 1, 40), table, partitions=4)
    apply_retention(spark, table, T0 + 11, os.path.join(tmp_dir, "stage"))
    tail.tail_run(tail.tail_source(spark, table).drop("terms", "log_date"), out, ck, NOW).awaitTermination()
    assert sorted(r.id for r in read_unique(spark, out).collect()) == list(range(11, 41))


def test_dedup_run_over_shuffled_batches_and_replay(spark, tmp_dir):
    from logloom.sinks.unique import rows_by_content
    from logloom.streaming.ingest import dedup_run

    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    spread = [(i, T0 + (i * 7919 % 50) * 86_400 * 10**9, "ns", f"p{i % 3}", "c", 3, f"m{i % 40}", None) for i in range(600)]
    df = spark.createDataFrame(spread, LOG_SCHEMA)
    df.repartition(8, F.xxhash64("id")).write.parquet(src)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    dedup_run(stream, out, os.path.join(tmp_dir, "ck"), trigger=NOW).awaitTermination()
    key = ["ts_ns", "namespace", "pod", "container", "message"]
    want = df.select(*key).distinct()
    got = read_unique(spark, out).select(*key)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    sink, twice = rows_by_content(spark, os.path.join(tmp_dir, "o2")), df.where("id < 100")
    for epoch in (0, 1, 1, 2):
        sink(twice, epoch)                     # re-delivered in other epochs, and one epoch replayed
    assert read_unique(spark, os.path.join(tmp_dir, "o2")).count() == twice.select(*key).distinct().count()


def test_tail_resume_batch_form(spark):
    df = rows(spark, 1, 300)
    got = [r.id for r in tail.tail_resume(df, 120).collect()]
    assert got == list(range(121, 221))


def test_read_structured_round_trip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "batch")
    rows(spark, 1, 5).write.parquet(path)
    back = read_structured(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in LOG_SCHEMA]
    assert back.count() == 5
    assert read_logs(spark, path).where(F.col("id") == 3).count() == 1


def test_ingest_rejects_oversize_and_ignores_replays(spark, tmp_dir):
    from logloom.streaming.ingest import RAW_STREAM_SCHEMA, ingest_stream, stream_raw_lines

    src = os.path.join(tmp_dir, "raw")
    lines = [(1, "ns", "p", "u1", "c", "2024-01-15T10:30:00Z level=info msg=hello", 0),
             (2, "ns", "p", "u1", "c", "2024-01-15T10:30:01Z [ERROR] boom", 0),
             (3, "ns", "p", "u1", "c", "2024-01-15T10:30:02Z " + "x" * 5000, 0),
             (4, "ns", "p", "u1", "c", "2024-01-15T10:30:01Z [ERROR] boom", 0)]   # re-delivered line
    spark.createDataFrame(lines, RAW_STREAM_SCHEMA).coalesce(1).write.parquet(src)
    table, ck = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "ck")
    q = ingest_stream(spark, stream_raw_lines(spark, src), table, ck, trigger={"availableNow": True},
                      max_line_bytes=1000)
    q.awaitTermination()
    got = sorted((r.id, r.severity, r.message, r.attributes["pod_uid"]) for r in read_logs(spark, table).collect())
    assert got == [(1, 3, "hello", "u1"), (2, 5, "[ERROR] boom", "u1")]
    assert spark.read.parquet(os.path.join(ck, "rejected")).count() == 1
    assert not os.path.exists(os.path.join(ck, "stage", "epoch-0"))      # nothing staged is left


def test_tail_open(spark):
    df = rows(spark, 1, 300)
    first = [r.id for r in tail.tail_open(df, {"minSeverity": "4", "endTime": "2024-01-01T00:00:00Z",
                                               "limit": "7", "order": "asc"}).collect()]
    assert first == [i for i in range(201, 301) if i % 2]     # newest 50, oldest first; no end time
    again = [r.id for r in tail.tail_open(df, {"minSeverity": "4", "lastId": "250"}).collect()]
    assert again == [i for i in range(251, 301) if i % 2]
    bad = [r.id for r in tail.tail_open(df, {"lastId": "-3"}).collect()]
    assert len(bad) == 50 and bad[-1] == 300


def test_ingest_gate_since_and_structured(spark, tmp_dir):
    from pyspark.sql import types as T

    from logloom.streaming.ingest import RAW_STREAM_SCHEMA, ingest_stream, with_structured

    raw, ready = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "ready")
    spark.createDataFrame([(1, "ns", "p", "u", "c", "2024-01-15T10:30:00Z a=1 early", 0),
                           (2, "ns", "p", "u", "c", "2024-01-15T10:40:00Z late", 0),
                           (3, "kube-system", "p", "u", "c", "2024-01-15T10:40:00Z hidden", 0)],
                          RAW_STREAM_SCHEMA).write.parquet(raw)
    entry = T.StructType([f for f in LOG_SCHEMA.fields if f.name != "id"] + [T.StructField("arrival", T.LongType())])
    t = 1705315200 * 10**9 + 10 * 3600 * 10**9
    spark.createDataFrame([(t, "ns", "p", "c", 5, "structured", {"k": "v"}, 9), (5, "ns", "p", "c", 5, "too old", None, 10)],
                          entry).write.parquet(ready)
    both = with_structured(spark.readStream.schema(RAW_STREAM_SCHEMA).parquet(raw), spark.readStream.schema(entry).parquet(ready))
    table = os.path.join(tmp_dir, "logs")
    ingest_stream(spark, both, table, os.path.join(tmp_dir, "ck"), trigger=NOW, exclude=("kube-system",),
                  since_ns=1705314900 * 10**9).awaitTermination()
    got = sorted((r.message, r.severity) for r in read_logs(spark, table).collect())
    assert got == [("late", 0), ("structured", 5)]


def test_text_files_as_a_stream_keep_their_order(spark, tmp_dir):
    """Container files -> ingest; ids follow the files' time and the lines' place."""
    import os as _os

    from logloom.sources.logs import read_raw_lines, stream_raw_text
    from logloom.streaming.ingest import ingest_stream

    root, table = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "logs")
    files = [("live", "api_x-7_u1", "app", "1.log", 300), ("live", "api_x-7_u1", "app", "0.log", 200), ("trial", "db_u2", "edge", "0.log", 50)]
    for age, (ns, pod, container, name, n) in enumerate(files):
        folder = os.path.join(root, ns, pod, container)
        _os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        with open(path, "w") as f:
            f.writelines(f"2024-01-15T10:30:00Z {pod} {name} line {i}\n" for i in range(n))
        _os.utime(path, (1_700_000_000 + age * 60,) * 2)            # 1.log is older than 0.log
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")     # several splits per file
    try:
        lines = read_raw_lines(spark, root)
        got = [r.line.split(" ", 1)[1] for r in lines.orderBy("arrival").collect()]
        assert got == [f"{pod} {name} line {i}" for _, pod, _, name, n in files for i in range(n)]
        assert {(r.namespace, r.pod, r.pod_uid, r.container) for r in lines.collect()} == {("live", "api_x-7", "u1", "app"), ("trial", "db", "u2", "edge")}
        q = ingest_stream(spark, stream_raw_text(spark, root, max_files=10), table, os.path.join(tmp_dir, "ck"), trigger=NOW)
        q.awaitTermination()
        assert [r.message for r in read_logs(spark, table).orderBy("id").collect()] == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_tails_share_a_sink(spark, tmp_dir):
    """Epochs of a fresh checkpoint begin at 0 again: nothing of the first tail is overwritten."""
    out = os.path.join(tmp_dir, "out")
    for k in range(2):
        table = os.path.join(tmp_dir, f"logs{k}")
        write_log_table(rows(spark, 1 + 500 * k, 500), table)
        tail.tail_run(tail.tail_source(spark, table).drop("terms", "log_date"), out, os.path.join(tmp_dir, f"ck{k}"), NOW).awaitTermination()
    assert sorted(r.id for r in read_unique(spark, out).collect()) == list(range(1, 1001))
    again = tail.tail_source(spark, os.path.join(tmp_dir, "logs0")).drop("terms", "log_date")
    tail.tail_run(again, out, os.path.join(tmp_dir, "ck2"), NOW).awaitTermination()
    assert read_unique(spark, out).count() == 1000


def _data_files(out):
    return [os.path.join(at, n) for at, _, names in os.walk(out) for n in names if n.endswith(".parquet") and n[0] not in "._"]


def test_epochs_of_a_sink_are_merged(spark, tmp_dir, monkeypatch):
    """Files of a sink stay few over many epochs, rows stay unique, and a merge that dies is finished."""
    from logloom.sinks import fs, unique

    out, key = os.path.join(tmp_dir, "out"), ["id"]
    sink = unique.unique_sink(spark, out, key, F.floor(F.col("id") / 500), "id", merge=3)
    seen, most = set(), 0
    for epoch in range(9):
        ids = [epoch * 5 + k for k in range(8)] + [3]  # each batch repeats rows of earlier ones
        seen |= set(ids)
        sink(spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").coalesce(1), epoch)
        most = max(most, len(_data_files(out)))
    assert sorted(r.id for r in read_unique(spark, out).collect()) == sorted(seen)
    assert most <= 2 * 3 and all("epoch=m2-" in f for f in _data_files(out))  # below 3 of each level, then one

    real, calls = fs.rename, []

    def dying(spark, src, dst):
        calls.append(src)
        if len(calls) > 3:
            raise OSError("lost")
        return real(spark, src, dst)

    monkeypatch.setattr(fs, "rename", dying)
    with pytest.raises(OSError):
        unique.merge_unique(spark, out, "id", merge=1)
    monkeypatch.setattr(fs, "rename", real)
    sink(spark.createDataFrame([(i, f"v{i}") for i in [*sorted(seen), 1000]], "id long, v string"), 9)
    assert sorted(r.id for r in read_unique(spark, out).collect()) == [*sorted(seen), 1000]


def test_another_querys_epochs_are_left_alone(spark, tmp_dir):
    from logloom.sinks import unique

    out, slot = os.path.join(tmp_dir, "out"), F.lit(0)
    for k in range(2):
        sink = unique.unique_sink(spark, out, ["id"], slot, "id", merge=2)
        for epoch in range(2 - k):
            sink(spark.range(100 * k + 10 * epoch, 100 * k + 10 * epoch + 10).coalesce(1), epoch)
    one = unique.unique_sink(spark, out, ["id"], slot, "id", merge=1)
    one(spark.range(500, 510).coalesce(1), 0)
    assert len([f for f in _data_files(out) if "epoch=m" not in f]) == 2  # both not merged by either
    assert unique.merge_unique(spark, out, "id", merge=2) >= 2 and read_unique(spark, out).count() == 40


def test_bounds_of_many_slots_stay_narrow(spark):
    from logloom.sinks.unique import near

    slots = [(k, k * 100, k * 100 + 5) for k in range(200)]
    df = spark.range(200 * 100).select((F.col("id") / 100).cast("long").alias("slot"), F.col("id").alias("bound"))
    hit = df.where(near(slots, F.col("slot"), F.col("bound")))
    wanted = df.where("bound % 100 <= 5")
    assert wanted.exceptAll(hit).isEmpty() and hit.count() < 16_000
    assert df.where(near(slots[:1], F.col("slot"), F.col("bound"))).count() == 6
