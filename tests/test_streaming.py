"""Streaming twins replayed from files (several micro-batches) against the
expected batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.operators.align import sync
from tidepool.operators.completion import job_output
from tidepool.sources.payloads import work_payloads
from tidepool.streaming.operators import (stream_job_output, stream_session_totals,
                                          stream_sessions_with_final, stream_sync)
from tidepool.streaming.replay import replay_stream, run_to_table, write_replay_files

T0 = dt.datetime(2024, 1, 1)
END = dt.datetime(9999, 12, 31)
SCHEMA = "k string, ts timestamp_ntz, fin boolean, id long, v long"


def _events(spark, spec, key="k"):
    rows = [(key, T0 + dt.timedelta(seconds=int(tok[1:])), tok[0] == "F", i, 1)
            for i, tok in enumerate(spec.split())]
    return spark.createDataFrame(rows, SCHEMA)


def _stream(spark, df, n_files=3, order="ts"):
    end = spark.createDataFrame([("__end__", END, False, -1, 0)], SCHEMA)
    path, n = write_replay_files(df, order, n_files, end_rows=end)
    return replay_stream(spark, path, df.schema, n)


def _sessions(spark, spec, lone_final="close", n_files=3, watermark="0 seconds"):
    st = _stream(spark, _events(spark, spec), n_files)
    s = stream_sessions_with_final(st, "k", "ts", 30, is_final=F.col("fin"), tiebreak="id",
                                   value=F.col("v"), lone_final=lone_final, watermark=watermark,
                                   end_marker=F.col("k") == "__end__")
    rows = run_to_table(s, "t-stream").collect()
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    return sorted(((r["session_start_us"] - base) // 10**6, r["n_events"], r["closed"],
                   (r["session_end_us"] - r["session_start_us"]) // 10**6) for r in rows)


@pytest.mark.parametrize("spec,expected", [
    ("n0 n10 F20", [(0, 3, True, 20)]),
    ("n0 n10 F20 n25 n40", [(0, 3, True, 20), (25, 2, False, 45)]),
    ("n0 n30", [(0, 1, False, 30), (30, 1, False, 30)]),
    ("F0 n10", [(0, 1, True, 0), (10, 1, False, 30)]),
    # two finals: the first closes, the second is a lone one
    ("n0 F10 F15", [(0, 2, True, 10), (15, 1, True, 0)]),
    # two finals at the same instant close two sessions
    ("n0 F5 F5", [(0, 2, True, 5), (5, 1, True, 0)]),
])
def test_stream_sessions_fixtures(spark, spec, expected):
    assert _sessions(spark, spec) == expected


def test_stream_absorb_lone_final(spark):
    assert _sessions(spark, "F0 n10 n100 F200", lone_final="absorb") == [(0, 4, True, 200)]
    # the default closes a lone final at once
    assert _sessions(spark, "F0 n10 n100 F200") == [
        (0, 1, True, 0), (10, 1, False, 30), (100, 1, False, 30), (200, 1, True, 0)]


def test_stream_out_of_order_within_lateness(spark):
    # rows written newest-first; a generous watermark delay lets the
    # processor put them back in event-time order
    df = _events(spark, "n0 n10 F20 n25 n40")
    rev = df.withColumn("ts_rev", F.lit(T0) - (F.col("ts") - F.lit(T0)))
    end = spark.createDataFrame([("__end__", END, False, -1, 0)], SCHEMA) \
        .withColumn("ts_rev", F.lit(END))
    path, n = write_replay_files(rev, "ts_rev", 3, end_rows=end)
    st = replay_stream(spark, path, rev.schema, n)
    s = stream_sessions_with_final(st, "k", "ts", 30, is_final=F.col("fin"), tiebreak="id",
                                   watermark="1 day", end_marker=F.col("k") == "__end__")
    got = sorted(r["n_events"] for r in run_to_table(s, "t-ooo").collect())
    assert got == [2, 3]


@pytest.mark.parametrize("n_files", [1, 3])
def test_stream_session_totals(spark, n_files):
    """One total per key (NULL too), as grouping the batch sessions gives."""
    e = _events(spark, "n0 n10 n100 n200 n210 n220", key="a").unionByName(
        _events(spark, "n5 n35 n36", key=None)).unionByName(_events(spark, "n7", key="b"))
    s = stream_session_totals(_stream(spark, e, n_files), "k", "ts", 30, tiebreak="id",
                              value=F.col("v"), end_marker=F.col("k") == "__end__")
    rows = run_to_table(s, "t-totals").collect()
    assert {r["k"]: tuple(r)[1:] for r in rows} == {
        "a": (3, 6, 3, 6), None: (2, 3, 2, 3), "b": (1, 1, 1, 1)}
    assert len(rows) == 3


def test_session_totals_of_early_times_and_delayed_watermark(spark):
    """Times before 1970, where watermarks begin, and a delayed watermark: no
    session comes too late for the totals."""
    early = spark.createDataFrame(
        [("a", dt.datetime(1961, 5, 1, 0, 0, 0, 1), False, 1, 5),
         ("a", dt.datetime(1961, 5, 1, 0, 0, 29), False, 2, 6),
         ("a", dt.datetime(2024, 1, 1), False, 3, 7)], SCHEMA)
    mixed = _events(spark, "n100 n0 n20 n90 n130 n60", key="b")
    st = _stream(spark, early.unionByName(mixed), 1)
    s = stream_session_totals(st, "k", "ts", 30, tiebreak="id", value=F.col("v"),
                              watermark="5 minutes", end_marker=F.col("k") == "__end__")
    rows = run_to_table(s, "t-totals").collect()
    assert {r["k"]: tuple(r)[1:] for r in rows} == {"a": (2, 3, 2, 18), "b": (4, 6, 2, 6)}


def _kv(spark, rows, vtype="bigint"):
    return spark.createDataFrame([(k, v, t, i) for i, (k, v, t) in enumerate(rows)],
                                 f"key string, value {vtype}, arrival_ts long, arrival_id long")


@pytest.mark.parametrize("match", ["occurrence", "arrival"])
def test_stream_sync_equals_batch(spark, match):
    a = _kv(spark, [("k1", 1, 0), ("k2", 2, 1), ("k1", 7, 5), ("k3", 3, 6)])
    b = _kv(spark, [("k1", 4, 2), ("k2", 5, 3), ("k2", 8, 4), ("k1", 9, 7)])
    streams = [replay_stream(spark, path, a.schema, n) for path, n in
               (write_replay_files(d, "arrival_ts", 2) for d in (a, b))]
    got = run_to_table(stream_sync(streams, match=match), f"t-sync-{match}")
    want = sync([a, b], match=match)
    cols = ["key", "occurrence", "value_0", "value_1"] if match == "occurrence" else \
        ["key", "group"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in want.select(*cols).collect())


def test_stream_farm_payloads(spark):
    p = work_payloads(spark, graphs=1, jobs=2, tasks=3, outputs=4, seed=3)
    path, n = write_replay_files(p, "arrival", 3)
    st = replay_stream(spark, path, p.schema, n)
    g = run_to_table(stream_job_output(st, "graphid", arrival=["arrival"]), "t-farm-g").collect()
    assert [len(r["outputs"]) for r in g] == [24]
    batch = job_output(p, "graphid", arrival=["arrival"]).collect()
    assert g[0]["outputs"] == batch[0]["outputs"]
    st = replay_stream(spark, path, p.schema, n)
    j = run_to_table(stream_job_output(st, "jobid", arrival=["arrival"]), "t-farm-j").collect()
    assert sorted(len(r["outputs"]) for r in j) == [12, 12]


PAYLOAD = ("graphid bigint, jobid bigint, taskid bigint, jobtasks map<string,int>,"
           " output array<string>, arrival bigint")


@pytest.mark.parametrize("declared", [[3, 2, 2, 1, 5], [2, 2, 2, 2], [1, None, 2, 3, 2],
                                      [None, None], [4, 4, 4]])
def test_changing_declared_counts_fire_alike(spark, declared):
    """The count is compared with the number the current payload declares, in
    batch as on a stream; a NULL output adds nothing."""
    rows = [(g, 0, i, {"0": d}, None if i == 1 else [f"{g}/{i}"], i)
            for g in (1, 2) for i, d in enumerate(declared)]
    p = spark.createDataFrame(rows, PAYLOAD)
    want, seen, outs = [], 0, []
    for i, d in enumerate(declared):
        seen, outs = seen + 1, outs + ([] if i == 1 else [i])
        if seen == d:
            want.append((len(want) + 1, seen, outs))
            seen, outs = 0, []
    want = sorted((g, f, n, [f"{g}/{i}" for i in o]) for g in (1, 2) for f, n, o in want)
    view = ["graphid", "fire", "n_payloads", "outputs"]
    # one job per graph: a NULL count counts as no part of the graph's sum
    batch = job_output(p, "jobid", arrival=["arrival"]).select(*view).collect() \
        if None not in declared else None
    if batch is not None:
        assert sorted(map(tuple, batch)) == want
    path, n = write_replay_files(p, "arrival", 2)
    st = replay_stream(spark, path, p.schema, n)
    if None not in declared:
        got = run_to_table(stream_job_output(st, "jobid", arrival=["arrival"]), "t-changing")
        assert sorted(map(tuple, got.select(*view).collect())) == want


def test_replay_slices_are_written_by_many_tasks(spark):
    from pyspark.sql import functions as F2

    from tidepool.session import dropped, live_tables
    before = set(live_tables())
    df = spark.range(100).withColumn("t", F2.col("id"))
    path, n = write_replay_files(df, "t", 3, end_rows=df.limit(1))
    assert n >= 4
    batches = []
    q = (replay_stream(spark, path, df.schema, n).writeStream
         .foreachBatch(lambda b, i: batches.append(sorted(r.t for r in b.collect())))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert [len(b) for b in batches][3:] == [1] and sum(batches[:3], []) == list(range(100))
    assert set(live_tables()) - before == {path}  # the staging copy is gone
    dropped(path)
    assert set(live_tables()) == before


def test_sync_orders_by_all_columns(spark):
    from tidepool.streaming.operators import stream_sync_tagged
    rows = [("k", 0, i, 5, "x", z) for i, z in enumerate([3, None, 1, 2])]
    df = spark.createDataFrame(rows, "key string, src int, value_0 int, t bigint, u string,"
                                     " z bigint")
    path, n = write_replay_files(df, "t", 1)
    for order in (["t", "u", "z"], ["z"]):
        st = replay_stream(spark, path, df.schema, n)
        got = run_to_table(stream_sync_tagged(st, 1, order=order), "t-order").collect()
        assert [r.value_0 for r in sorted(got, key=lambda r: r.occurrence)] == [1, 2, 3, 0]


def test_rocksdb_is_asked_for(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    path, n = write_replay_files(spark.range(1).selectExpr(
        "'k' key", "0 src", "1 value_0", "id arrival_ts", "id arrival_id"), "arrival_ts", 1)
    st = replay_stream(spark, path, "key string, src int, value_0 int, arrival_ts bigint,"
                                    " arrival_id bigint", n)
    try:
        spark.conf.set(key, "org.example.Other")
        from tidepool.streaming.operators import stream_sync_tagged
        with pytest.raises(RuntimeError, match="RocksDB"):
            stream_sync_tagged(st, 1)
        assert spark.conf.get(key) == "org.example.Other"
    finally:
        spark.conf.set(key, was)


def test_stream_payloads_twice_fire_twice(spark):
    p = work_payloads(spark, graphs=1, jobs=2, tasks=3, outputs=1, seed=1) \
        .withColumn("arrival", F.col("jobid") * 10 + F.col("taskid"))
    p2 = p.unionByName(p.withColumn("arrival", F.col("arrival") + 1000))
    path, n = write_replay_files(p2, "arrival", 2)
    st = replay_stream(spark, path, p2.schema, n)
    g = run_to_table(stream_job_output(st, "graphid", arrival=["arrival"]), "t-twice").collect()
    assert sorted(r["fire"] for r in g) == [1, 2]


def test_stream_late_rows_are_dropped(spark):
    # the third file holds a row older than everything already applied
    df = _events(spark, "n100 n110 n0").withColumn(
        "order", F.when(F.col("id") == 2, F.lit(3)).otherwise(F.col("id")))
    end = spark.createDataFrame([("__end__", END, False, -1, 0)], SCHEMA).withColumn(
        "order", F.lit(10))
    path, n = write_replay_files(df, "order", 3, end_rows=end)
    st = replay_stream(spark, path, df.schema, n)
    s = stream_sessions_with_final(st, "k", "ts", 30, tiebreak="id",
                                   end_marker=F.col("k") == "__end__")
    got = [r["n_events"] for r in run_to_table(s, "t-late").collect()]
    assert got == [2]


def test_stream_messages_to_lines(spark, tmp_dir):
    """Messages read as a stream, event time from an attribute, words out as
    text lines through a checkpointed stream sink."""
    import os

    from tidepool.functions.scalar import format_pair
    from tidepool.sinks import with_attributes, write_lines, write_messages
    from tidepool.sources.files import read_lines
    from tidepool.sources.messages import event_time_from_attribute, read_messages

    src = spark.createDataFrame([("hello world", "1447679463000"), ("solo", "1447679464000")],
                                "d string, ts string")
    write_messages(with_attributes(src, F.col("d"), timestamp=F.col("ts")),
                   path=os.path.join(tmp_dir, "in"))
    msgs = event_time_from_attribute(read_messages(spark, os.path.join(tmp_dir, "in")),
                                     watermark="1 minute")
    words = msgs.select(format_pair(F.col("data").cast("string"),
                                    F.unix_millis("event_time")).alias("value"))
    q = write_lines(words, os.path.join(tmp_dir, "out"),
                    checkpoint=os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r["value"] for r in read_lines(spark, os.path.join(tmp_dir, "out", "*.txt"))
                 .collect())
    assert got == ["hello world: 1447679463000", "solo: 1447679464000"]


def test_stream_sync_longest_flushes_at_end(spark):
    from tidepool.streaming.operators import stream_sync_tagged
    rows = [("k1", 0, 1, None, T0 + dt.timedelta(seconds=1), 0),
            ("k1", 1, None, "x", T0 + dt.timedelta(seconds=2), 1),
            ("k2", 0, 7, None, T0 + dt.timedelta(seconds=3), 2),
            ("k1", 0, 3, None, T0 + dt.timedelta(seconds=4), 3),
            (None, None, None, None, END, 4)]
    df = spark.createDataFrame(rows, "key string, src int, value_0 bigint, value_1 string, "
                                     "arrival_ts timestamp_ntz, arrival_id long")
    path, n = write_replay_files(df, "arrival_ts", 2)
    st = replay_stream(spark, path, df.schema, n)
    s = stream_sync_tagged(st, 2, mode="longest", end_marker=F.col("src").isNull())
    got = sorted((r["key"], r["occurrence"], r["value_0"], r["value_1"])
                 for r in run_to_table(s, "t-longest").collect())
    assert got == [("k1", 1, 1, "x"), ("k1", 2, 3, None), ("k2", 1, 7, None)]
    with pytest.raises(ValueError):
        stream_sync_tagged(st, 2, mode="longest")


def test_stream_user_score_golden(spark):
    """The reference's streaming replay of the 9 golden lines."""
    from tests.test_scores import GOLDEN
    from tidepool.functions.parse import parse_game_event
    from tidepool.streaming.operators import stream_group_values
    from tidepool.streaming.replay import run_updates_to_table
    lines = spark.createDataFrame([(line, i) for i, line in enumerate(GOLDEN)],
                                  "value string, i long")
    path, n = write_replay_files(lines, "i", 3)
    st = replay_stream(spark, path, lines.schema, n)
    runs = run_updates_to_table(stream_group_values(parse_game_event(st), "user", "score"),
                                ["user", "score"], "t-golden")
    got = {}
    for r in runs.collect():
        got.setdefault(r["user"], []).extend([r["score"]] * r["n"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "user1": [14, 18, 18], "user2": [2], "user3": [3, 5, 8], "user4": [2, 5]}


def test_stream_dead_letter_and_tap(spark):
    """Row-level operators run unchanged on a stream: the dead-letter split
    and a tap whose counts appear in the query's progress."""
    from tidepool.operators.route import dead_letter, errors, tap

    def fail_on_five(x):
        if x == 5:
            raise ValueError("five is not accepted")

    df = spark.range(10).withColumnRenamed("id", "item")
    path, n = write_replay_files(df, "item", 2)
    st = tap(replay_stream(spark, path, df.schema, n), "items")
    out = dead_letter(st, fail_on_five, ["item"], initial_delay=0.0)
    q = (out.writeStream.format("memory").queryName("dl_test").trigger(availableNow=True)
            .start())
    q.awaitTermination()
    rows = spark.table("dl_test")
    assert rows.count() == 10
    assert [r["item"] for r in errors(rows).collect()] == [5]
    seen = sum(p["observedMetrics"]["items"]["items_rows"] for p in q.recentProgress
               if p.get("observedMetrics", {}).get("items"))
    assert seen == 10
