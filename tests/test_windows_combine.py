"""Merging windows, changing declared numbers, combiners, one-to-many
functions, stream fan-out, and the state of the stream processors."""

import datetime as dt
import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepool.functions.rows import flat_map
from tidepool.operators import combine, windows
from tidepool.operators.combine import combine_by_key
from tidepool.operators.completion import (job_output, job_output_and_rest, job_output_rows,
                                           ready_keys)
from tidepool.operators.windows import assign_merged_windows, merged_windows
from tidepool.plans import queries as Q
from tidepool.session import claimed_path, session_settings
from tidepool.streaming import processors
from tidepool.streaming.counters import BudgetExceeded, StreamCounters
from tidepool.streaming import fan_out
from tidepool.streaming.fan_out import run_fan_out
from tidepool.streaming.operators import (late_only, on_time, stream_job_output,
                                          stream_sessions_with_final)
from tidepool.streaming.processors import FinalSessionProcessor
from tidepool.streaming.replay import replay_stream, run_to_table, write_replay_files

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# --- merging windows ----------------------------------------------------------

def plain_windows(rows):
    """{id: window number} by walking each key's windows in order of start."""
    out = {}
    for key in {r[0] for r in rows}:
        number, top = 0, None
        for _, i, s, e in sorted((r for r in rows if r[0] == key and None not in r[2:]
                                  and r[3] > r[2]), key=lambda r: (r[2], r[3])):
            if top is None or s >= top:
                number, top = number + 1, e
            top = max(top, e)
            out[i] = number
    return out


@pytest.mark.parametrize("hot_key_rows", [0, 2, 10**6])
def test_merged_windows_equal_plain_version(spark, monkeypatch, hot_key_rows):
    tables, written = [], windows.written
    monkeypatch.setattr(windows, "written",
                        lambda df, name: tables.append(written(df, name)) or tables[-1])
    rng = random.Random(hot_key_rows)
    rows = []
    for i in range(400):
        s = rng.randrange(3000)
        rows.append((rng.choice(["hot", "hot", "a", "b", None]), i, s,
                     s + rng.choice([0, -5, 1, 3, 10, 10, 200])))
    rows += [("hot", 900 + i, 50, 60) for i in range(60)]  # a group of equal windows
    rows += [("a", 1000, None, 5), ("a", 1001, 5, None), ("touch", 1002, 0, 10),
             ("touch", 1003, 10, 20), ("touch", 1004, 19, 30)]
    df = spark.createDataFrame(
        [(k, i, None if s is None else at(s), None if e is None else at(e), "x")
         for k, i, s, e in rows], "k string, id long, s timestamp, e timestamp, window_seq string")
    got = assign_merged_windows(df, "k", "s", "e", partitions=5, hot_key_rows=hot_key_rows)
    assert {r.id: r.window_seq for r in got.collect()} == plain_windows(rows)
    if hot_key_rows == 0:
        (ranged,) = [t for t in tables if "_mw_pid" in t.columns and "_mw_seq" in t.columns]
        assert ranged.where("k = 'hot'").select("_mw_pid").distinct().count() > 1
    ends = {(r.k, r.window_seq): (r.window_start, r.window_end, r.n_events)
            for r in merged_windows(df, "k", "s", "e", hot_key_rows=hot_key_rows).collect()}
    assert ends["touch", 1][2] == 1 and ends["touch", 2][2] == 2
    assert ends["touch", 2][1] - ends["touch", 2][0] == dt.timedelta(seconds=20)


def test_merged_windows_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    assert merged_windows(df, "k", "s", "e").collect() == []


# --- declared numbers that change -----------------------------------------------

def payloads(spark, rows):
    """(graph, declared number, arrival) as payloads."""
    return spark.createDataFrame(
        [(g, {} if e is None else {"0": e}, 0, a, [f"p{a}"], a) for g, e, a in rows],
        "graphid long, jobtasks map<string,int>, jobid long, taskid long, output array<string>, "
        "arrival long")


def plain_firings(rows):
    out, rest = [], []
    for g in {r[0] for r in rows}:
        held, fired = [], 0
        for _, e, a in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            held.append(a)
            if (e or 0) == len(held):
                fired += 1
                out.append((g, fired, len(held), [f"p{x}" for x in held]))
                held = []
        rest += held
    return sorted(out, key=str), sorted(rest)


def shown(df):
    return sorted(((r.graphid, r.fire, r.n_payloads, r.outputs) for r in df.collect()), key=str)


def test_hot_key_with_changing_numbers_equals_plain_version(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, 3, 4, None]), rng.choice([None, 0, -1, 1, 2, 2, 3, 3, 4, 9]), a)
            for a in range(600)]
    rows += [(9, 3, 1000 + a) for a in range(7)]  # one number only
    rows += [(10, None, 2000), (11, 10**6, 2001)]
    expected, rest = plain_firings(rows)
    df = payloads(spark, rows).repartition(3)
    assert shown(job_output(df, "graphid", arrival=["arrival"], partitions=6)) == expected
    done, left = job_output_and_rest(df, "graphid", arrival=["arrival"])
    assert shown(done) == expected
    assert sorted(r.arrival for r in left.collect()) == rest
    assert left.columns == df.columns
    with session_settings(spark, {"spark.sql.adaptive.enabled": "false",
                                  "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        hot = job_output_rows(df, "graphid", arrival=["arrival"]).where("graphid = 1")
        parts = hot.select(F.spark_partition_id().alias("part")).distinct().count()
    assert parts > 1  # no task holds the hot key


def test_long_path_needs_few_rounds(spark, monkeypatch):
    from tidepool.operators import completion
    written, rounds = completion.written, []
    monkeypatch.setattr(completion, "written",
                        lambda df, name: (rounds.append(name), written(df, name))[1])
    rows = [(1, 1 + a % 2, a) for a in range(300)]
    assert shown(job_output(payloads(spark, rows), "graphid", arrival=["arrival"])) \
        == plain_firings(rows)[0]
    assert rounds.count("completion-jumps") <= 10  # about log2 of 200 firings


# --- combiners --------------------------------------------------------------------

@pytest.mark.parametrize("fan_in,partitions", [(2, 9), (64, 1), (3, 30)])
def test_combiner_does_not_depend_on_grouping(spark, monkeypatch, fan_in, partitions):
    monkeypatch.setattr(combine, "HELD_KEYS", 2)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(-5, 50)]))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(partitions)
    got = combine_by_key(df, "k", ["v"], Q.Moments(),
                         "n bigint, total bigint, squares bigint, top string", fan_in=fan_in)
    expected = {}
    for k in {"hot", "a", None}:
        v = [x for key, x in rows if key == k and x is not None]
        expected[k] = (len(v), sum(v), sum(x * x for x in v),
                       ",".join(map(str, sorted(v)[-3:][::-1])))
    assert {r.k: (r.n, r.total, r.squares, r.top) for r in got.collect()} == expected


def test_combiner_of_two_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (1, "x", 7)], "a int, b string, v int")
    got = combine_by_key(df, ["a", "b"], ["v"], Q.Moments(), "n long, t long, s long, top string")
    assert {(r.a, r.b): r.t for r in got.collect()} == {(1, "x"): 12, (1, "y"): 6}
    assert combine_by_key(df.limit(0), ["a"], ["v"], Q.Moments(),
                          "n long, t long, s long, top string").collect() == []
    with pytest.raises(ValueError):
        combine_by_key(df, "a", ["v"], Q.Moments(), "n long", fan_in=1)


# --- one-to-many functions -----------------------------------------------------------

def test_flat_map_keeps_columns_and_cuts_batches(spark):
    def repeated(text, n, sep="-"):
        for i in range(n or 0):
            yield i, None if text is None else f"{text}{sep}{i}"

    rows = [(1, "a", 3), (2, None, 2), (3, "b", 0), (4, "", None), (5, "c", 1000)]
    df = spark.createDataFrame(rows, "id long, t string, n int")
    got = flat_map(df, repeated, ["t", "n"], "i long, x string", keep=["id"], batch_rows=7, sep="+")
    expected = [(k, i, None if t is None else f"{t}+{i}") for k, t, n in rows for i in range(n or 0)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert got.columns == ["id", "i", "x"]
    assert flat_map(df.limit(0), repeated, ["t", "n"], "i long, x string").collect() == []
    with pytest.raises(ValueError, match="both kept and yielded"):
        flat_map(df, repeated, ["t", "n"], "id long, x string", keep=["id"])


# --- stream fan-out -------------------------------------------------------------------

def test_fan_out_after_a_failed_batch_doubles_nothing(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice([1, 2, 3, 5]), a) for a in range(90)]
    df = payloads(spark, rows)
    replay, n = write_replay_files(df, "arrival", 3)
    path = claimed_path(spark, "t-fan-out")
    calls = Counter()

    def branches(fail):
        def graphs(batch):
            calls["graphs"] += 1
            if fail and calls["graphs"] == 2:
                raise RuntimeError("lost")
            return job_output_and_rest(batch, "graphid", arrival=["arrival"])
        return {"all": lambda batch: (batch.select("arrival"), None), "graphs": graphs}

    def run(fail):
        return run_fan_out(replay_stream(spark, replay, df.schema, n), branches(fail), path)

    with pytest.raises(Exception, match="lost"):
        run(True)  # "all" has written the second micro-batch
    found = run(False)
    assert sorted(r.arrival for r in found["all"].collect()) == list(range(90))
    got = sorted((r.graphid, r.n_payloads, r.outputs) for r in found["graphs"].collect())
    assert got == sorted((g, k, o) for g, _, k, o in plain_firings(rows)[0])


def test_keyed_fan_out_carries_waiting_rows_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.choice([2, 3, 5, None]), a) for a in range(100)]
    rows += [(100 + a, 9, a) for a in range(100)]  # these wait for ever
    df = payloads(spark, rows)
    replay, n = write_replay_files(df, "arrival", 4)
    path = claimed_path(spark, "t-keyed-fan-out")
    monkeypatch.setattr(fan_out, "PARTS", 2)
    calls, parts = Counter(), {}

    def run(fail):
        def graphs(batch):
            calls["graphs"] += 1
            if fail and calls["graphs"] == 4:
                raise RuntimeError("lost")
            for i in range(4):
                at = f"{path}/graphs/carried/{i}"
                if fan_out._exists(spark, at):
                    parts[i] = {r.graphid for r in spark.read.parquet(at).collect()}
            return job_output_and_rest(batch, "graphid", arrival=["arrival"])

        branch = fan_out.KeyedBranch(["graphid"], lambda r: ready_keys(r, "graphid"), graphs)
        with session_settings(spark, {"tidepool.hotKeyRows": "1000"}):
            return run_fan_out(replay_stream(spark, replay, df.schema, n), {"graphs": branch}, path)

    with pytest.raises(Exception, match="lost"):
        run(True)  # the fourth micro-batch has written its bitmap
    assert shown(run(False)["graphs"].select("graphid", F.lit(0).alias("fire"), "n_payloads",
                                             "outputs")) \
        == sorted(((g, 0, k, o) for g, _, k, o in plain_firings(rows)[0]), key=str)
    assert calls["graphs"] == 5
    # what waits is in the part of its micro-batch, until a part of all is written
    waits = [len([g for g in parts[i] if g is not None and g >= 100]) for i in range(3)]
    assert waits[0] + waits[1] < waits[2] and 0 < waits[1] < 40


# --- processors -------------------------------------------------------------------------

class FakeState:
    """Value and map states that say which buckets were read."""

    def __init__(self):
        self.value, self.map, self.read, self.timers = None, {}, [], []

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, update=self._update)

    def _update(self, value):
        self.value = value

    def getMapState(self, name, key, value):
        return SimpleNamespace(updateValue=self.map.__setitem__, removeKey=self.map.pop,
                               getValue=lambda k: (self.read.append(k), self.map[k])[1])

    def registerTimer(self, at_ms):
        self.timers.append(at_ms)


def session_rows(times):
    return [{"ev_t": t * 1_000_000, "ev_final": False, "ev_tb": t, "ev_v": 1} for t in times]


def watermark(seconds):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: seconds * 1000)


def test_a_timer_reads_no_later_bucket(monkeypatch):
    monkeypatch.setattr(processors, "BUCKET_ROWS", 10)
    state = FakeState()
    p = FinalSessionProcessor(["k"], 5_000_000)
    p.init(state)
    times = random.Random(1).sample(range(0, 2000, 2), 200)
    list(p.handleInputRows(("a",), session_rows(times[:100]), watermark(0)))
    list(p.handleInputRows(("a",), session_rows(times[100:]), watermark(0)))
    assert len(state.map) == 20 and not state.read
    begins = {k: v[0][0] for k, v in state.map.items()}
    out = list(p.handleExpiredTimer(("a",), watermark(300), None))
    assert state.read and all(begins.get(k, 0) <= 300_000_000 for k in state.read)
    assert len(state.read) < 8
    held = sum(len(v[0]) for v in state.map.values())
    assert held == sum(t > 300 for t in times)
    out += p.handleExpiredTimer(("a",), watermark(10_000), None)
    assert not state.map and sum(r["n_events"] for r in out) == 200
    own = sorted(times)
    assert len(out) == 1 + sum(b - a >= 5 for a, b in zip(own, own[1:]))


def test_on_time_and_late_rows_are_the_input(spark):
    schema = "k string, ts timestamp, id long, turn int"
    rng = random.Random(6)
    rows = [(rng.choice("ab"), at(rng.randrange(5000)), i, 0 if i < 150 else 1 if i < 200 else 2)
            for i in range(300)]
    df = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("__end__", dt.datetime(9999, 12, 31), -1, 2)], schema)
    path, n = write_replay_files(df, "turn", end_rows=end, bounds=[0, 1])
    s = stream_sessions_with_final(
        replay_stream(spark, path, df.schema, n), "k", "ts", 30, tiebreak="id", value=F.lit(1),
        end_marker=F.col("k") == "__end__", late="emit")
    t = run_to_table(s, "t-late")
    late = late_only(t).collect()
    assert 50 <= len(late) <= 100 and all(r.late_event_us <= r.watermark_us for r in late)
    ids = {r.late_tiebreak for r in late}
    assert ids <= {r[2] for r in rows if r[3] == 2} and len(ids) == len(late)
    assert on_time(t).agg(F.sum("n_events")).first()[0] + len(late) == len(rows)
    # the sessions are those of the rows that were not late
    own = [sorted(r[1] for r in rows if r[0] == k and r[2] not in ids) for k in "ab"]
    gaps = sum(1 + sum((y - x).total_seconds() >= 30 for x, y in zip(o, o[1:])) for o in own)
    assert on_time(t).count() == gaps


@pytest.mark.parametrize("slices", [1, 4])
def test_idle_keys_come_out_incomplete_and_state_is_dropped(spark, monkeypatch, slices):
    monkeypatch.setattr(processors, "INLINE_PATHS", 1)
    times = [("a", 0, 3), ("a", 10, 3), ("a", 200, 2), ("a", 210, 2), ("a", 220, 5),
             ("b", 5, 1), ("b", 104, 9), ("b", 205, 9), ("c", 300, 4)]
    schema = ("graphid string, ts timestamp, id long, jobtasks map<string,int>, jobid long, "
              "taskid long, output array<string>")
    rows = [(g, at(s), i, {"0": e}, 0, i, [f"{g}{s}", "x"]) for i, (g, s, e) in enumerate(times)]
    df = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("z", dt.datetime(9999, 12, 31), -1, {}, 0, 0, [])], schema)
    path, n = write_replay_files(df, "ts", slices, end_rows=end)
    s = stream_job_output(replay_stream(spark, path, df.schema, n), "graphid", arrival=["ts", "id"],
                          idle_seconds=100, event_time="ts", end_marker=F.col("id") == -1)
    got = sorted((r.graphid, r.first_us, r.fire, r.n_payloads, r.complete, r.outputs[::2])
                 for r in run_to_table(s, "t-idle").collect())
    zero = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert [(g, (u - zero) // 10**6, f, k, c, o) for g, u, f, k, c, o in got] == [
        ("a", 0, 1, 2, False, ["a0", "a10"]), ("a", 200, 1, 2, True, ["a200", "a210"]),
        ("a", 220, 2, 1, False, ["a220"]), ("b", 5, 1, 1, True, ["b5"]),
        ("b", 104, 2, 1, False, ["b104"]), ("b", 205, 1, 1, False, ["b205"]),
        ("c", 300, 1, 1, False, ["c300"])]


# --- counters and budgets of streams ----------------------------------------------------

def test_a_budget_stops_a_stream_and_restarts_go_on_counting(spark):
    df = spark.range(90).withColumn("at", F.col("id"))
    replay, n = write_replay_files(df, "at", 3)
    path = claimed_path(spark, "t-budget")

    def counted():
        return replay_stream(spark, replay, df.schema, n).observe("o", F.count(F.lit(1)).alias("n"))

    def start(writer, once=False):
        writer = writer.format("parquet").option("path", f"{path}/out") \
            .option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start()

    with StreamCounters(spark, {"n": 90}) as counters:
        first = counters.run(counted(), lambda w: start(w, once=True))
        assert 0 < first["n"] <= 90
        assert counters.run(counted(), start)["n"] == 90  # both runs of the query
        assert spark.read.parquet(f"{path}/out").count() == 90
    path = claimed_path(spark, "t-budget")
    with StreamCounters(spark, {"n": 20}) as counters, pytest.raises(BudgetExceeded, match="over 20"):
        counters.run(counted(), start)
