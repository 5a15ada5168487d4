"""Container lifecycle: batch state machine, hot-key buckets, stream = batch."""

import os

from logloom.operators.lifecycle import active_containers, container_events, container_restarts
from logloom.schema import STATUS_SCHEMA
from logloom.streaming.lifecycle import container_events_stream, read_container_events


def snaps(spark, rows):
    data = [("ns", pod, "uid-" + pod, "main", seq, kind, running, rc, cid)
            for pod, seq, kind, running, rc, cid in rows]
    return spark.createDataFrame(data, STATUS_SCHEMA)


CASE = [("p", 1, "status", True, 0, "x"), ("p", 2, "status", True, 0, "x"), ("p", 3, "status", True, 1, "y"),
        ("p", 4, "status", False, 1, "y"), ("p", 5, "status", False, 1, "y"),
        # unseen and not running: remembered only; then a start
        ("q", 1, "status", False, 0, "a"), ("q", 2, "status", True, 0, "a"),
        # deletion stops even a stopped container and forgets it
        ("r", 1, "status", True, 0, "b"), ("r", 2, "status", False, 0, "b"), ("r", 3, "deleted", False, 0, "b"),
        ("r", 4, "status", True, 0, "b")]
WANT = [("p", 1, "START"), ("p", 3, "START"), ("p", 4, "STOP"), ("q", 2, "START"),
        ("r", 1, "START"), ("r", 2, "STOP"), ("r", 3, "STOP"), ("r", 4, "START")]


def got(df):
    return sorted((r.pod, r.seq, r.event) for r in df.collect())


def test_state_machine(spark):
    assert got(container_events(snaps(spark, CASE))) == WANT


def test_bucket_edges_do_not_matter(spark):
    # width 1 and 2: every snapshot or every pair in its own bucket
    for width in (1, 2, 3):
        assert got(container_events(snaps(spark, CASE), bucket_width=width)) == WANT


def test_hot_key_many_buckets(spark):
    rows = [("hot", i, "status", i % 7 != 0, 0, f"c{i // 50}") for i in range(1, 2000)]
    small = got(container_events(snaps(spark, rows), bucket_width=37))
    big = got(container_events(snaps(spark, rows), bucket_width=1 << 20))
    assert small == big and len(small) > 100


def test_restarts_and_active(spark):
    s = snaps(spark, CASE)
    ev = container_events(s)
    r = {x.pod: (x.max_restart_count, x.restarts) for x in container_restarts(s, ev).collect()}
    assert r == {"p": (1, 1), "q": (0, 0), "r": (0, 1)}
    assert sorted(x.pod for x in active_containers(ev).collect()) == ["q", "r"]


def run_stream(spark, tmp_dir, parts, **how):
    """One file per micro-batch, in the given order."""
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    for part in parts:
        snaps(spark, part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(STATUS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = container_events_stream(stream, out, ck, {"availableNow": True}, **how)
    q.awaitTermination()
    return got(read_container_events(spark, out))


def test_stream_equals_batch_in_any_order(spark, tmp_dir):
    late = [CASE[6:], CASE[2:4], CASE[:2], CASE[4:6], CASE[:3]]      # late snapshots, then a replay
    assert run_stream(spark, os.path.join(tmp_dir, "a"), late) == WANT
    backwards = [CASE[k:k + 2] for k in range(len(CASE) - 1, -1, -2)] + [CASE[:1]]
    assert run_stream(spark, os.path.join(tmp_dir, "b"), backwards) == WANT


def test_stream_goes_on_from_its_checkpoint(spark, tmp_dir):
    """A restart finds its state, and the last epoch delivered again replaces itself."""
    for part in (CASE[:5], CASE[5:]):
        run_stream(spark, tmp_dir, [part])
    assert got(read_container_events(spark, os.path.join(tmp_dir, "out"))) == WANT
    commits = os.path.join(tmp_dir, "ck", "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    os.remove(os.path.join(commits, str(last)))                     # died before it was committed
    if os.path.exists(os.path.join(commits, f".{last}.crc")):
        os.remove(os.path.join(commits, f".{last}.crc"))
    assert run_stream(spark, tmp_dir, []) == WANT


def test_a_fresh_checkpoint_is_refused(spark, tmp_dir):
    import pytest

    assert run_stream(spark, tmp_dir, [CASE]) == WANT
    stream = spark.readStream.schema(STATUS_SCHEMA).parquet(os.path.join(tmp_dir, "in"))
    with pytest.raises(Exception, match="another checkpoint|another"):
        container_events_stream(stream, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck2"),
                                {"availableNow": True}).awaitTermination()
    assert got(read_container_events(spark, os.path.join(tmp_dir, "out"))) == WANT


def test_state_follows_the_containers_that_live(spark, tmp_dir):
    import time

    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))

    def run(part):
        snaps(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(STATUS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = container_events_stream(stream, out, ck, {"availableNow": True}, forget_ms=1)
        q.awaitTermination()
        return [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators][-1]

    def pod(name, *kinds):
        return [(name, i, k, True, 0, "x") for i, k in enumerate(kinds)]

    first = run(pod("a", "status", "deleted") + pod("b", "status") + pod("d", "status", "deleted"))
    time.sleep(0.2)
    run(pod("e", "status"))
    assert first == 3 and run(pod("f", "status")) == 3            # b, e, f


def test_snapshots_older_than_all_that_are_kept_are_reported(spark, tmp_dir):
    from logloom.streaming.lifecycle import late_snapshots

    one = [("p", i, "status", i % 2 == 0, 0, "x") for i in range(20)]
    run_stream(spark, tmp_dir, [one[1:], one[:1], one[15:16]], keep=4)
    late = [r.seq for r in late_snapshots(spark, os.path.join(tmp_dir, "out")).collect()]
    events = {r.seq for r in read_container_events(spark, os.path.join(tmp_dir, "out")).collect()}
    assert late == [0] and events == set(range(2, 20))


def test_stream_runs_over_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    snaps(spark, CASE).repartition(8, "seq").write.parquet(src)
    stream = spark.readStream.schema(STATUS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    container_events_stream(stream, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"),
                            {"availableNow": True}).awaitTermination()
    assert got(read_container_events(spark, os.path.join(tmp_dir, "out"))) == WANT


def test_idle_does_not_depend_on_batches(spark, tmp_dir):
    from logloom.schema import LOG_SCHEMA
    from logloom.streaming.idle import idle_now, last_lines_stream

    H = 3600 * 10**9
    T0 = 1704110400 * 10**9
    lines = [("a", 0), ("b", 6), ("b", 0), ("a", 5), ("b", 10), ("b", 2)]
    for k, order in enumerate((lines, lines[::-1])):
        src = os.path.join(tmp_dir, f"in{k}")
        for i, (pod, h) in enumerate(order):
            spark.createDataFrame([(i, T0 + h * H, "ns", pod, "main", 3, "m", None)],
                                  LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        out = os.path.join(tmp_dir, f"out{k}")
        last_lines_stream(s, out, os.path.join(tmp_dir, f"ck{k}"), {"availableNow": True}).awaitTermination()
        assert [(r.pod, (r.last_ts_ns - T0) // H) for r in idle_now(spark, out, T0 + 12 * H, 3 * H).collect()] == [("a", 5)]
        assert idle_now(spark, out, T0 + 5 * H, 3 * H).isEmpty()


H = 3600 * 10**9
T0 = 1704110400 * 10**9


def plain_idle(lines, timeout, lateness):
    """(pod, last line) of every timeout that passed before the last watermark."""
    now = max(t for _, t in lines) // 10**6 - lateness // 10**6
    out = []
    for pod in {p for p, _ in lines}:
        times = sorted({t for p, t in lines if p == pod})
        out += [(pod, t) for t, nxt in zip(times, times[1:] + [None])
                if (nxt is None or nxt - t > timeout) and -(-(t + timeout) // 10**6) < now]
    return sorted(out)


def test_idle_events_with_a_restart_between(spark, tmp_dir):
    """Lines out of order by up to half an hour, in batches; every timeout is
    reported once, a later line cancels it, state ends with the timers."""
    import random

    from logloom.schema import LOG_SCHEMA
    from logloom.streaming.idle import idle_events_stream, read_idle_events

    rng = random.Random(4)
    lines = sorted(((rng.choice("abcdef"), T0 + rng.randrange(24 * 60) * H // 60 + rng.randrange(10**9)) for _ in range(160)), key=lambda r: r[1])
    lines += [("late-pod", T0 + 2 * H), ("late-pod", T0 + 2 * H), ("z", T0 + 30 * H)]
    arrival = sorted(lines, key=lambda r: r[1] + rng.randrange(H // 2))
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    size = -(-len(arrival) // 8)
    for part in (range(0, 3), range(3, 8)):                       # the query stops and starts again
        for k in part:
            spark.createDataFrame([(i, t, "ns", pod, "main", 3, "m", None) for i, (pod, t) in enumerate(arrival[k * size:(k + 1) * size])],
                                  LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = idle_events_stream(s, out, ck, timeout_ns=H, lateness="30 minutes", trigger={"availableNow": True})
        q.awaitTermination()
    got = sorted((r.pod, r.last_ts_ns) for r in read_idle_events(spark, out).collect())
    assert got == plain_idle(lines, H, H // 2) and len(got) > 20
    assert all(r.idle_ns == r.last_ts_ns + H for r in read_idle_events(spark, out).collect())
    assert [p.stateOperators[0].numRowsTotal for p in q.recentProgress][-1] == 1        # z


def test_open_timers():
    from logloom.streaming.idle import open_timers

    assert open_timers([], 5) == [] and open_timers([1], 5) == [1]
    assert open_timers([1, 6, 12, 13], 5) == [6, 13]


def test_epoch_folders_are_merged(spark, tmp_dir):
    """Over many epochs the folders that a reader opens stay few, also when the
    last epoch is delivered again."""
    from logloom.sinks.epochs import EpochLog

    log = EpochLog(spark, os.path.join(tmp_dir, "log"), "k bigint", merge=4)
    most = 0
    frames = [spark.range(k, k + 1).toDF("k").coalesce(1) for k in range(3)]
    for epoch in range(40):
        for _ in range(2 if epoch % 7 == 0 else 1):
            log.write(frames[epoch % 3], epoch)
        most = max(most, len([n for n in os.listdir(log.path) if n[0] == "m"]))
    assert most <= 10 and {n[:3] for n in os.listdir(log.path) if n[0] == "m"} >= {"m00", "m02"}
    want = sorted((e % 3, e) for e in range(40))
    assert sorted((r.k, r.epoch) for r in log.read().collect()) == want
    spark.range(9).toDF("k").selectExpr("k", "5L as epoch").write.parquet(os.path.join(log.path, "m00-000000000005"))   # not deleted by a merge
    assert sorted((r.k, r.epoch) for r in log.read().collect()) == want
