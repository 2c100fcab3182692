"""Input the tables do not hold: null times and keys, odd CSV, JSON and
number texts, failing calls, scratch tables."""

import csv
import datetime as dt
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions.parse import game_event_fields, parse_json_payload
from tidepool.functions.scalar import as_float
from tidepool.operators.completion import job_output, job_output_rows
from tidepool.operators.ordered import number_rows, number_sessions
from tidepool.operators.route import dead_letter, errors, row_budget_guard
from tidepool.session import (checkpoint_root, dropped, live_tables, scratch_scope, written)

T0 = dt.datetime(2020, 1, 1)
GAP = 10
TIMES = [None, 0, 0, 5, 9, 10, 19, 20, 40, -3, -100, 10 ** 9, -10 ** 9]
events = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(TIMES),
                            st.booleans()), min_size=1, max_size=25)


def sessions_by_hand(rows):
    out, last, seq = {}, {}, {}
    order = sorted((r for r in rows if r[1] is not None),
                   key=lambda r: (str(r[0]), r[1], r[2], r[3]))
    for key, t, final, i in order:
        before = last.get(key)
        if before is None or before[1] or t - before[0] >= GAP:
            seq[key] = seq.get(key, 0) + 1
        out[i], last[key] = seq[key], (t, final)
    return {r[3]: out.get(r[3]) for r in rows}


@settings(max_examples=6, deadline=None)
@given(events)
def test_sessions_have_one_meaning_on_both_paths(spark, spec):
    rows = [(k, t, f, i) for i, (k, t, f) in enumerate(spec)]
    df = spark.createDataFrame(
        [(k, None if t is None else T0 + dt.timedelta(seconds=t), f, i) for k, t, f, i in rows],
        "k string, t timestamp_ntz, f boolean, i int")
    want = sessions_by_hand(rows)
    for threshold, parts in ((0, 1), (0, 3), (1, 2), (10 ** 6, None)):
        with scratch_scope():
            got = number_sessions(df, ["k"], "t", GAP, tiebreak=["i"], final=F.col("f"),
                                  partitions=parts, hot_key_rows=threshold, keep_untimed=True)
            assert {r.i: r.session_seq for r in got.collect()} == want


def test_only_hot_keys_take_the_range_scan(spark):
    df = spark.createDataFrame([("hot", i) for i in range(9)] + [("cold", 1), (None, 1)],
                               "k string, i int")
    before = set(live_tables())
    out = number_rows(df, ["k"], ["i"], hot_key_rows=5)
    new = {t.rsplit("/", 1)[1].rsplit("-", 1)[0]: t for t in live_tables() if t not in before}
    scanned = spark.read.parquet(new["ordered-scan"])
    assert {r.k for r in scanned.select("k").distinct().collect()} == {"hot"}
    assert sorted((str(r.k), r.i, r.rn) for r in out.collect()) == sorted(
        [("hot", i, i + 1) for i in range(9)] + [("cold", 1, 1), ("None", 1, 1)])
    dropped(*new.values())


def test_a_scope_leaves_no_table_behind(spark):
    import os
    with scratch_scope():
        path = written(spark.range(3), "scope-test").scratch
        assert os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and path not in live_tables()


def test_a_cluster_gets_no_local_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    for fallback in (None, "/tmp/x", "file:///tmp/x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_root(Session(), fallback)


def test_the_guard_passes_every_row(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, v int")
    assert sorted(r.v for r in row_budget_guard(df, 2, ["k"]).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="row budget 1 exceeded by a key with 2 rows"):
        row_budget_guard(df, 1, ["k"]).collect()
    assert row_budget_guard(df.where("false"), 0, ["k"]).collect() == []


def test_failing_calls_run_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def fail_on_three(x):
        calls.add(1)
        if x % 3 == 0:
            raise ValueError("three")

    tried = dead_letter(spark.range(10), fail_on_three, ["id"], retries=0)
    assert sorted(r.id for r in errors(tried).collect()) == [0, 3, 6, 9] and calls.value == 10
    calls.value = 0
    kept = dead_letter(spark.range(10), fail_on_three, ["id"], retries=0, keep_failed=False)
    assert kept.count() == 6 and calls.value == 10


LINES = ['us"er,te"am,5,1447679463000', '"a""b",t,5,1000', '"a""b,c",t,5,1000', '"a\\",t,5,1000',
         "u,t,5,1000,more,fields", "u,t,5", "", '"q,r",t, 7 ,1', "u,,5,1", ",,+5,1", "u,t,5.0,1",
         "u,t,5,x", '"u","t","5","1000"']


def test_csv_lines_read_as_the_csv_module_reads_them(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").select(
        "line", game_event_fields(F.col("line")).alias("e")).collect()
    for r in rows:
        fields = next(csv.reader(io.StringIO(r.line)), [])
        try:
            want = (fields[0], fields[1], int(fields[2]), int(fields[3]))
        except (IndexError, ValueError) as e:
            assert (r.e.reason == "too_few_fields") == isinstance(e, IndexError), r
            continue
        ms = int(r.e.event_time.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        assert r.e.reason is None and (r.e.user, r.e.team, r.e.score, ms) == want


JSON = ['{"k": 1} junk', '{"k": 1}{"k": 2}', "{'k': 1}", '{"k": 1}', "[1]", "1", "", '{"k": "x"}',
        '{"k": 1},{"k": 2}', "{}", "null", '{"z": [1, {"a": 2}], "k": 3}', ' {"k": 5} ', '{"k": 1',
        "]", '{"k": 1}]', '{"k": 1}, 0], 1']


def test_json_objects_only(spark):
    rows = parse_json_payload(spark.createDataFrame([(x,) for x in JSON], "data string"),
                              "k INT").collect()
    for r in rows:
        try:
            value = json.loads(r.data)
        except ValueError:
            value = None
        assert r.json_error == (not isinstance(value, dict)), r
        if not r.json_error:
            k = value.get("k")
            assert r.payload.k == (k if isinstance(k, int) else None)


def test_float_texts(spark):
    texts = ["1d", "1.0f", "0x1p3", " 1.5 ", "-2e3", ".5", "5.", "inf", "-Infinity", "nan", "1_0",
             "", "e5", "+7"]
    got = spark.createDataFrame([(x,) for x in texts], "v string").select(
        "v", as_float("v").alias("f")).collect()
    for r in got:
        try:
            want = float(r.v.replace("_", "?"))
        except ValueError:
            want = None
        assert r.f == want or (want != want and r.f != r.f), r


PAYLOADS = ("graphid bigint, jobid bigint, taskid bigint, jobtasks map<string,int>,"
            " output array<string>, arrival bigint")


def test_large_ids_and_null_outputs(spark):
    big = 3_000_000_201
    rows = [(big, 0, 0, {"0": 2}, None, 1), (big, 0, 1, {"0": 2}, ["x"], 2),
            (None, 0, 1, {"0": 1}, ["y"], 1)]
    got = job_output(spark.createDataFrame(rows, PAYLOADS), "graphid", arrival=["arrival"])
    assert sorted((str(r.graphid), r.outputs) for r in got.collect()) == [
        (str(big), ["x"]), ("None", ["y"])]


def test_incomplete_keys_are_not_gathered(spark):
    rows = [(1, 0, i, {"0": 1000}, ["x"], i) for i in range(50)] + [(2, 0, 0, {"0": 1}, ["y"], 1)]
    p = spark.createDataFrame(rows, PAYLOADS)
    kept = job_output_rows(p, "graphid", arrival=["arrival"]).collect()
    assert [(r.graphid, r.fire, r.place, r.n_payloads, r.output) for r in kept] == [
        (2, 1, 1, 1, ["y"])]
