"""Store conformance: write, filters, get by id, retention, stats, paging,
dedup on append — on the Parquet table."""

import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logloom.operators.paging import next_page_query, page, page_info
from logloom.operators.query import LogQuery, apply_query
from logloom.operators.stats import stats
from logloom.schema import LOG_SCHEMA, RAW_SCHEMA
from logloom.sinks.retention import apply_retention, record_run, retention_stats
from logloom.sinks.table import append_new, write_log_table
from logloom.sources.logs import read_logs

H = 3600 * 10**9
T0 = 1704110400 * 10**9  # 2024-01-01T12:00:00Z


def rows(spark, specs):
    """specs: (id, ts_ns, namespace, severity, message, attributes)"""
    data = [(i, ts, ns, "pod", "main", sev, msg, attrs) for i, ts, ns, sev, msg, attrs in specs]
    return spark.createDataFrame(data, LOG_SCHEMA)


def table(spark, tmp_dir, specs):
    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, specs), path)
    return read_logs(spark, path)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters(spark, tmp_dir):
    t = table(spark, tmp_dir, [
        (1, T0, "production", 3, "first", {"user_id": "123"}),
        (2, T0 + H, "staging", 5, "second", {"user_id": "456"}),
        (3, T0 + 2 * H, "production", 2, "third", None),
    ])
    assert ids(apply_query(t, LogQuery(start_ns=T0 + H // 2, end_ns=T0 + 3 * H // 2))) == [2]
    assert ids(apply_query(t, LogQuery(namespace="production"))) == [1, 3]
    assert ids(apply_query(t, LogQuery(min_severity=4))) == [2]
    assert ids(apply_query(t, LogQuery(attributes={"user_id": "123"}))) == [1]
    assert ids(t.where(F.col("id") == 2)) == [2] and ids(t.where(F.col("id") == 99999)) == []
    assert ids(apply_query(t, LogQuery(search="second"))) == [2]
    s = stats(t).first()
    assert (s.total, s.oldest_ns, s.newest_ns) == (3, T0, T0 + 2 * H)
    assert [r.id for r in page(t, LogQuery()).collect()] == [3, 2, 1]
    assert [r.id for r in page(t, LogQuery(order="asc")).collect()] == [1, 2, 3]


def test_pushdown_and_partition_pruning(spark, tmp_dir):
    t = table(spark, tmp_dir, [(1, T0, "production", 3, "a", None), (2, T0 + 30 * H, "staging", 5, "b", None)])
    plan = apply_query(t, LogQuery(start_ns=T0 + 25 * H, namespace="staging"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "namespace" in plan
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_paging_limit(spark, tmp_dir):
    t = table(spark, tmp_dir, [(i, T0 + i, "ns", 3, f"m{i}", None) for i in range(1, 11)])
    q = LogQuery(limit=3)
    assert [r.id for r in page(t, q).collect()] == [10, 9, 8]
    info = page_info(t, q).first()
    assert info.has_more and info.next_cursor == 7 and info.resume_id == 8 and info.total_estimate == -1


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=1, max_value=7), st.sampled_from(["asc", "desc"]))
def test_page_walk_is_complete(spark, limit, order):
    df = rows(spark, [(i, T0 + i, "ns", i % 6, f"m{i}", None) for i in range(1, 24)])
    q = LogQuery(limit=limit, order=order, min_severity=1)
    seen = []
    while True:
        got = [r.id for r in page(df, q).collect()]
        seen += got
        info = page_info(df, q).first()
        if not info.has_more:
            break
        q = next_page_query(q, info.resume_id)
    want = sorted((i for i in range(1, 24) if i % 6 >= 1), reverse=(order == "desc"))
    assert seen == want


def test_retention(spark, tmp_dir):
    now = T0 + 48 * H
    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, [(1, now - 48 * H, "ns", 3, "old", None), (2, now - H, "ns", 3, "new", None),
                                 (3, now - 24 * H - 1, "ns", 3, "boundary-old", None),
                                 (4, now - 24 * H + 1, "ns", 3, "boundary-new", None)]), path)
    deleted = apply_retention(spark, path, now - 24 * H, tmp_dir)
    assert deleted == 2
    assert sorted(r.message for r in read_logs(spark, path).collect()) == ["boundary-new", "new"]
    runs = os.path.join(tmp_dir, "runs")
    record_run(spark, runs, now, now - 24 * H, deleted)
    r = retention_stats(spark.read.parquet(runs)).first()
    assert (r.runs, r.total_deleted, r.last_run_ns) == (1, 2, now)


def test_append_dedup_and_ids(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    stage = os.path.join(tmp_dir, "stage")

    def batch(specs):
        return spark.createDataFrame(
            [(a, ts, ns, "pod", "main", sev, msg, None) for a, ts, ns, sev, msg in specs],
            "arrival long, ts_ns long, namespace string, pod string, container string, severity int, "
            "message string, attributes map<string,string>")

    b1 = batch([(1, T0, "ns", 3, "same"), (2, T0, "ns", 5, "same"), (3, T0 + 1, "ns", 3, "same"),
                (4, T0, "other", 3, "same"), (5, T0, "ns", 3, "different")])
    r1 = append_new(spark, b1, path, stage)
    assert r1 == {"offered": 5, "inserted": 4}
    r2 = append_new(spark, b1, path, stage)       # re-delivered batch
    assert r2["inserted"] == 0
    t = read_logs(spark, path)
    got = {(r.ts_ns, r.namespace, r.message): (r.id, r.severity) for r in t.collect()}
    assert got[(T0, "ns", "same")] == (1, 3)        # first arrival wins
    assert sorted(v[0] for v in got.values()) == [1, 2, 3, 4]
    r3 = append_new(spark, batch([(9, T0 + 5 * H, "ns", 2, "later")]), path, stage)
    assert r3["inserted"] == 1 and ids(read_logs(spark, path)) == [1, 2, 3, 4, 5]


def counted_fs(monkeypatch, at, how):
    """Let the ``at``-th changing file-system call fail: die before it, die
    after it, or report False without doing it."""
    from logloom.sinks import fs

    calls = []
    for name in ("rename", "delete"):
        def call(*args, real=getattr(fs, name), name=name):
            calls.append((name, *args[1:]))
            if len(calls) == at:
                if how == "before":
                    raise OSError("lost driver")
                if how == "false" and name == "rename":
                    return False
                real(*args)
                if how == "after":
                    raise OSError("lost driver")
                return True
            return real(*args)
        monkeypatch.setattr(fs, name, call)
    return calls


@pytest.mark.parametrize("how", ["before", "after", "false"])
def test_retention_killed_at_every_file_system_call(spark, tmp_dir, monkeypatch, how):
    """With posting lists and an append while the job is dead: no row that
    should stay is lost, the finished count is the same, lists fit the rows."""
    import shutil

    from logloom.sources.logs import read_postings

    now = T0 + 48 * H
    cutoff = now - 24 * H
    first = [(1, now - 48 * H, "ns", 3, "old words", None), (2, now - H, "ns", 3, "new words", None),
             (3, cutoff - 1, "ns", 3, "boundary old", None), (4, cutoff + 1, "ns", 3, "boundary new", None)]
    more = [(5, cutoff + 2, "ns", 3, "boundary appended", None), (6, cutoff - 2, "ns", 3, "boundary late", None)]
    model = os.path.join(tmp_dir, "model")
    write_log_table(rows(spark, first), f"{model}/logs", postings_path=f"{model}/post")

    at, step = 0, {"before": 2, "after": 3, "false": 4}[how]
    while True:
        at += step if at else 1 + (how == "before")
        root = os.path.join(tmp_dir, f"{how}{at}")
        shutil.copytree(model, root)
        path, post, stage = f"{root}/logs", f"{root}/post", f"{root}/stage"
        with monkeypatch.context() as m:
            calls = counted_fs(m, at, how)
            try:
                done = apply_retention(spark, path, cutoff, stage, post)
            except (OSError, RuntimeError):
                done = None
        if len(calls) < at:
            assert done == 2 and at > 8
            break
        left = os.listdir(stage) if done is None and os.path.isdir(stage) else []
        staged = any(os.path.exists(f"{stage}/{d}/ready") for d in left if not d.endswith(".done"))
        if any(d.endswith(".done") for d in left):       # it died after its last step
            done = 2
        write_log_table(rows(spark, more[:1] if at % 2 else more), path, postings_path=post)   # an append meanwhile
        late = at % 2 == 0
        if done is None:
            # what was staged is finished as it was; an append before staging counts
            assert apply_retention(spark, path, cutoff, stage, post) == 2 + (late and not staged)
        again = apply_retention(spark, path, cutoff, stage, post)
        assert again == (late and (staged or done is not None))
        assert sorted(r.message for r in read_logs(spark, path).collect()) == ["boundary appended", "boundary new", "new words"]
        assert sorted((r.id, r.term) for r in read_postings(spark, post).collect()) == [
            (2, "new"), (2, "word"), (4, "boundari"), (4, "new"), (5, "append"), (5, "boundari")]
        assert apply_retention(spark, path, cutoff, stage, post) == 0
        assert not os.path.exists(stage) or os.listdir(stage) == []


def test_retention_replaces_only_files_with_old_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    cutoff = T0
    for k, ts in enumerate((cutoff - 5, cutoff + 5, cutoff + 6)):
        write_log_table(rows(spark, [(k + 1, ts, "ns", 3, f"m{k}", None)]), path)
    day = os.path.join(path, "log_date=2024-01-01")
    before = {f for f in os.listdir(day) if f.endswith(".parquet")}
    assert apply_retention(spark, path, cutoff, tmp_dir) == 1
    after = {f for f in os.listdir(day) if f.endswith(".parquet")}
    assert len(before & after) == 2 and ids(read_logs(spark, path)) == [2, 3]


def test_a_run_finishes_the_run_that_died_before_it(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, [(i, T0 + i * H, "ns", 3, f"m{i}", None) for i in range(1, 41)]), path)
    with monkeypatch.context() as m:
        counted_fs(m, 4, "before")
        with pytest.raises(OSError):
            apply_retention(spark, path, T0 + 15 * H, tmp_dir)
    assert apply_retention(spark, path, T0 + 20 * H, tmp_dir) == 5          # 15..19: 1..14 went with the first
    assert ids(read_logs(spark, path)) == list(range(20, 41))


def test_messages_are_stemmed_once_per_append(spark, tmp_dir):
    """The stemmer sees as many rows as are written, index or not."""
    from logloom.sinks import table as S

    real, counter = S.terms, spark.sparkContext.accumulator(0)

    def counting(message):
        def one(m):
            counter.add(1)
            return m
        return real(F.udf(one, "string").asNondeterministic()(message))
    S.terms = counting
    try:
        specs = [(i, T0 + i * H, "ns", 3, f"message number{i}", None) for i in range(1, 101)]
        paths = {"postings_path": os.path.join(tmp_dir, "post")}
        write_log_table(rows(spark, specs), os.path.join(tmp_dir, "logs"), **paths)
        assert counter.value == 100
        batch = rows(spark, [(i, ts + 1, n, s, m, a) for i, ts, n, s, m, a in specs]).withColumnRenamed("id", "arrival")
        append_new(spark, batch, os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "stage"), **paths)
        assert counter.value == 200
    finally:
        S.terms = real


def test_retention_job_records_runs_and_errors(spark, tmp_dir, monkeypatch):
    from logloom.sinks import retention as R

    path, runs = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "runs")
    write_log_table(rows(spark, [(1, T0, "ns", 3, "old", None), (2, T0 + 50 * H, "ns", 3, "new", None)]), path)
    assert R.retention_job(spark, path, T0 + 51 * H, 0, tmp_dir, runs) == 0        # off
    assert R.retention_job(spark, path, T0 + 51 * H, 1, tmp_dir, runs) == 1
    monkeypatch.setattr(R, "apply_retention", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        R.retention_job(spark, path, T0 + 52 * H, 1, tmp_dir, runs)
    r = retention_stats(spark.read.parquet(runs)).first()
    assert (r.runs, r.total_deleted, r.last_run_ns) == (2, 1, T0 + 52 * H) and "division" in r.last_error


def test_append_reads_only_its_own_days_and_no_ids(spark, tmp_dir):
    from logloom.sinks import table as S

    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, [(i, T0 + i * 24 * H, "ns", 3, f"m{i}", None) for i in range(1, 11)]), path)
    assert S.max_id(spark, path) == 10
    batch = rows(spark, [(1, T0 + 2 * 24 * H, "ns", 3, "m2", None), (2, T0 + 9 * 24 * H + 5, "ns", 3, "x", None)]) \
        .withColumnRenamed("id", "arrival")
    fresh = S.new_rows(batch, read_logs(spark, path))
    assert [r.message for r in fresh.collect()] == ["x"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts_ns" in plan and "PartitionFilters" in plan
    assert "log_date" in plan.split("PartitionFilters")[1][:200] and " id#" not in plan.split("FileScan")[1][:120]
    read = read_logs(spark, path).where(S.near([(r.d, r.a, r.b) for r in batch.groupBy(
        S.ns_to_date("ts_ns").alias("d")).agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b")).collect()],
        F.col("log_date"), F.col("ts_ns"))).select(F.input_file_name()).distinct().count()
    assert read <= 2


def test_append_log_compacts_and_survives_a_lost_append(spark, tmp_dir, monkeypatch):
    from logloom.sinks import appends as A, table as S

    monkeypatch.setattr(A, "COMPACT_FILES", 6)
    path = os.path.join(tmp_dir, "logs")
    for i in range(1, 6):
        write_log_table(rows(spark, [(i, T0 + i, "ns", 3, f"m{i}", None)]), path)
    assert A.ranges(spark, path)[0][:2] == (5, 5) and len(A.ranges(spark, path)) == 5 and S.max_id(spark, path) == 5
    A.record_append(spark, path, 6, 9, [])                      # died before its rows were written
    batch = rows(spark, [(1, T0 + 99, "ns", 3, "next", None)]).withColumnRenamed("id", "arrival")
    append_new(spark, batch, path, os.path.join(tmp_dir, "stage"))
    assert ids(read_logs(spark, path)) == [1, 2, 3, 4, 5, 10]


def test_many_appends_lose_nothing(spark, tmp_dir):
    """Counterpart of the reference's concurrent writers: with one writer per
    table, successive batches (each also re-sent once) all land, ids dense."""
    path = os.path.join(tmp_dir, "logs")
    schema = ("arrival long, ts_ns long, namespace string, pod string, container string, severity int, "
              "message string, attributes map<string,string>")
    for w in range(4):
        b = spark.createDataFrame([(i, T0 + w * 1000 + i, f"w{w}", "p", "c", 3, f"m{i}", None) for i in range(100)],
                                  schema)
        append_new(spark, b, path, os.path.join(tmp_dir, f"stage{w}"))
        append_new(spark, b, path, os.path.join(tmp_dir, f"stage{w}b"))
    t = read_logs(spark, path)
    assert t.count() == 400 and ids(t) == list(range(1, 401))


def test_pages_and_lookups_read_few_files(spark, tmp_dir):
    from logloom.operators.paging import get_by_id, stored_page, stored_page_info, stored_scope

    path = os.path.join(tmp_dir, "logs")
    for k in range(12):                                           # a day each
        write_log_table(rows(spark, [(k * 20 + i, T0 + k * 24 * H + i, "ns", i % 6, f"m{k}", None) for i in range(1, 21)]), path)
    t = read_logs(spark, path)

    def files(df):
        return df.select(F.input_file_name()).distinct().count()

    everything = files(t)
    for q in (LogQuery(limit=7), LogQuery(limit=7, order="asc"), LogQuery(limit=7, before_id=100), LogQuery(limit=7, after_id=100, order="asc"),
              LogQuery(limit=7, min_severity=4), LogQuery(limit=300), LogQuery(limit=5, namespace="none"), LogQuery(limit=7, before_id=-3)):
        assert [r.id for r in stored_page(spark, path, q).collect()] == [r.id for r in page(t, q).collect()]
        assert stored_page_info(spark, path, q).first() == page_info(t, q).first()
        if q.limit == 7:
            assert files(stored_scope(spark, path, q)) <= everything / 3
    assert [r.id for r in get_by_id(spark, path, 77).collect()] == [77]
    assert get_by_id(spark, path, 9999).isEmpty() and get_by_id(spark, path, -1).isEmpty()
    plan = get_by_id(spark, path, 77)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_disk_size_counts_the_files(spark, tmp_dir):
    from logloom.operators.stats import disk_size

    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, [(i, T0 + i * 24 * H, "ns", 3, "m", None) for i in range(1, 9)]), path)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs
             if f.endswith(".parquet") and "_appends" not in d]
    r = disk_size(spark, path).first()
    assert (r.bytes, r.files) == (sum(sizes), len(sizes))


@pytest.mark.parametrize("params,want", [
    ({"limit": "--5"}, {}), ({"limit": "+7"}, {"limit": 7}), ({"limit": "1001"}, {}), ({"minSeverity": "\u00b2"}, {}),
    ({"minSeverity": "-1"}, {}), ({"afterId": "9223372036854775808"}, {}), ({"beforeId": "-5"}, {"before_id": -5}),
    ({"limit": "1" * 5000}, {}), ({"startTime": "2024-01-15T00:00:00.5+02:00"}, {"start_ns": 1705269600500000000}),
    ({"startTime": "2024-W03-1T00:00:00Z"}, {}), ({"endTime": "2024-01-15T00:00:00"}, {}), ({"endTime": "9999-12-31T00:00:00Z"}, {}),
    ({"startTime": "2024-01-15 00:00:00Z"}, {}), ({"startTime": "1969-12-31T23:59:59.25Z"}, {"start_ns": -750000000}),
])
def test_request_parameters_are_strict(spark, params, want):
    assert LogQuery.from_params(params) == LogQuery(**want)
    if "before_id" in want:
        assert page(rows(spark, [(1, T0, "ns", 3, "m", None)]), LogQuery.from_params(params)).count() == 1
    assert LogQuery.from_tail_params({"lastId": "--3"})[1] is None


def test_append_log_stays_short_for_pages_and_lookups(spark, tmp_dir, monkeypatch):
    """A hundred thousand appends: a page and a lookup pull few rows of the log."""
    from logloom.operators.paging import get_by_id, stored_page
    from logloom.sinks import appends as A

    path = os.path.join(tmp_dir, "logs")
    write_log_table(rows(spark, [(i, T0 + i, "ns", 3, f"m{i}", None) for i in range(199_901, 200_001)]), path)
    day = "2024-01-01"
    many = spark.range(100_000).selectExpr("id * 2 + 1 as min_id", "id * 2 + 2 as max_id", f"array(date'{day}') as days")
    many.coalesce(1).write.mode("append").parquet(f"{path}/_appends/g00000000")
    pulled, real = [], A.ranges

    def counting(*a, **k):
        found = real(*a, **k)
        pulled.append(len(found))
        return found
    monkeypatch.setattr(A, "ranges", counting)
    assert [r.id for r in stored_page(spark, path, LogQuery(limit=10)).collect()] == list(range(200_000, 199_990, -1))
    assert [r.id for r in get_by_id(spark, path, 199_950).collect()] == [199_950]
    assert [r.id for r in stored_page(spark, path, LogQuery(limit=3, after_id=199_960, order="asc")).collect()] == [199_961, 199_962, 199_963]
    assert sum(pulled) < 100
    merged = A._merged(spark, path, A.read_appends(spark, path))
    assert merged.count() == 1 and tuple(merged.first()[:2]) == (1, 200_000)
    gone = spark.createDataFrame([(1, 5, []), (6, 9, [])], A.SCHEMA)           # no day is left: only the highest id stays
    assert [tuple(r[:2]) for r in A._merged(spark, path, gone).collect()] == [(6, 9)]


def test_stored_search_uses_the_posting_lists(spark, tmp_dir):
    from logloom.operators.paging import page, stored_page, stored_page_info, stored_tail_initial, stored_tail_resume, tail_initial
    from logloom.streaming.tail import tail_resume

    path, post = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "post")
    for k in range(4):
        write_log_table(rows(spark, [(k * 50 + i, T0 + k * 24 * H + i, "ns", i % 6, f"alpha word{i % 3} {k}", None) for i in range(1, 51)]),
                        path, postings_path=post)
    t = read_logs(spark, path)
    for q in (LogQuery(search="word1", limit=7), LogQuery(search="alpha word2", min_severity=3, order="asc", limit=9),
              LogQuery(search="word0 2", limit=100), LogQuery(search="nowhere"), LogQuery(search="word1", before_id=60, limit=5)):
        assert [r.id for r in stored_page(spark, path, q, post).collect()] == [r.id for r in page(t, q).collect()]
        assert stored_page_info(spark, path, q, post).first() == page_info(t, q).first()
        assert [r.id for r in stored_tail_initial(spark, path, q, 20, post).collect()] == [
            r.id for r in tail_initial(t, q.with_(before_id=None), 20).collect()]
        assert [r.id for r in stored_tail_resume(spark, path, q, 30, 10, post).collect()] == [r.id for r in tail_resume(t, 30, q, 10).collect()]
    plan = stored_page(spark, path, LogQuery(search="word1", limit=7), post)._jdf.queryExecution().executedPlan().toString()
    table_scan = [line for line in plan.splitlines() if "FileScan" in line and "severity" in line]
    assert table_scan and all("terms" not in line for line in table_scan)
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    opened = next(k for k, line in enumerate(lines) if "Generate inline" in line)
    assert any("Filter" in line and "= word1" in line for line in lines[opened:])    # below the blocks' expansion


def test_summaries_open_no_data_file(spark, tmp_dir):
    from logloom.operators.stats import list_containers, list_namespaces, stored_names, stored_stats, summarise

    path = os.path.join(tmp_dir, "logs")
    assert stored_stats(spark, path if os.path.exists(path) else tmp_dir).first().total == 0
    for k in range(3):
        write_log_table(rows(spark, [(k * 10 + i, T0 + k * 24 * H + i, f"ns{k}", 3, "m", None) for i in range(1, 11)]), path)
        assert summarise(spark, path) == len([f for f in os.listdir(os.path.join(path, sorted(
            d for d in os.listdir(path) if d.startswith("log_date="))[k])) if f.endswith(".parquet")])
    assert summarise(spark, path) == 0
    assert apply_retention(spark, path, T0 + 24 * H + 5, tmp_dir) == 14
    assert 0 < summarise(spark, path) <= 2                                    # only what retention rewrote
    t = read_logs(spark, path)
    assert stored_stats(spark, path).first() == stats(t).first()
    assert [r[0] for r in stored_names(spark, path, "namespaces").collect()] == [r[0] for r in list_namespaces(t).collect()]
    assert [r[0] for r in stored_names(spark, path, "containers").collect()] == [r[0] for r in list_containers(t).collect()]
    plan = stored_stats(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "namespace:string" not in plan and "ts_ns" not in plan and "_summary" in plan
