"""Stateful processors run for groups of keys: one state entry and one call
per group, the rows of each key as if it were alone."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.completion import job_output
from tidepool.plans.inputs import payloads_from_lineitem
from tidepool.streaming.key_groups import LARGE_ROWS, KeyGroups, _unpacked, bundled, grouped_rows
from tidepool.streaming.operators import stream_job_output
from tidepool.streaming.processors import CompletionProcessor, SyncProcessor
from tidepool.streaming.replay import replay_stream, run_to_table, write_replay_files

PAYLOAD = ("graphid bigint, jobid bigint, taskid bigint, jobtasks map<string,int>,"
           "output array<string>, arrival bigint, weight double")


def test_state_is_kept_per_group_of_keys(spark):
    """80 keys in 2 groups: 2 state entries (80 of one key each before), and
    the outputs of the batch operator; a null key and doubles that are null
    or not finite too."""
    odd = [None, math.nan, math.inf, 0.1]
    rows = [(g if g else None, 0, t, {"0": 3}, [f"{g}/{t}"] if t else None, g * 7 % 80, odd[(g + t) % 4])
            for t in range(3) for g in range(80)]
    p = spark.createDataFrame(rows, PAYLOAD)
    path, n = write_replay_files(p, "arrival", 2)
    progress: list = []
    s = stream_job_output(replay_stream(spark, path, p.schema, n), "graphid",
                          arrival=["arrival", "taskid"], groups=2)
    got = run_to_table(s, "t-groups", progress).collect()
    want = job_output(p, "graphid", arrival=["arrival", "taskid"]).collect()
    assert len(got) == 80
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(op["numRowsTotal"] for q in progress for op in q["stateOperators"]) == 2


class _State:
    """A value state, or a map state, of a stand-in store."""

    def __init__(self):
        self.value, self.entries = None, {}

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _State())

    def getMapState(self, name, key_schema, value_schema):
        return self.states.setdefault(name, _State())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_many_waiting_rows_lie_beside_the_group(spark):
    """A hot key's waiting rows are entries of their own, read again when they
    are matched; a key that compares unequal to itself is one key."""
    schema = T.StructType([T.StructField("key", T.DoubleType()), T.StructField("src", T.IntegerType()),
                           T.StructField("arr0", T.LongType()), T.StructField("value_0", T.LongType()),
                           T.StructField("value_1", T.LongType())])
    rows, packed = grouped_rows(spark.createDataFrame([], schema), ["key"], 8)
    assert [f.name for f in packed] == schema.names and len(rows.columns) == 2
    handle = _Handle()
    groups = KeyGroups(SyncProcessor(2, ["bigint", "bigint"], ["bigint"]), ["key"], packed)
    groups.init(handle)

    def fed(new):
        df, _ = grouped_rows(spark.createDataFrame(new, schema), ["key"], 8)
        return list(groups.handleInputRows((0,), iter([Row(*df.columns)(*r) for r in df.collect()]), None))

    many = LARGE_ROWS + 10
    assert fed([(math.nan, 0, i, i, None) for i in range(many)] + [(1.0, 0, 1, 5, None)]) == []
    assert len(handle.states["parts"].entries) == 1
    assert fed([(1.0, 1, 2, None, 6)])[0].asDict() == {
        "key": 1.0, "occurrence": 1, "value_0": 5, "value_1": 6}
    assert len(handle.states["parts"].entries) == 1
    out = fed([(math.nan, 1, i, None, -i) for i in range(many)])
    assert [(r["occurrence"], r["value_0"], r["value_1"]) for r in out] == [
        (i + 1, i, -i) for i in range(many)]
    assert handle.states["parts"].entries == {}


def test_rows_are_bundled_and_states_compressed(spark):
    """Rows of a key group are shuffled as one row, and a group's waiting keys
    are kept compressed (a row each, and 100 bytes of state for a payload of
    two paths, before)."""
    schema = T.StructType([T.StructField("graphid", T.LongType()), T.StructField("arr0", T.DoubleType()),
                           T.StructField("expected", T.LongType()),
                           T.StructField("output", T.ArrayType(T.StringType()))])
    rows = [(g if g else None, math.nan if g == 5 else g / 7, 2,
             [f"/beam/graph-{g}/job-0_output-{i}\n.task-ñ.ext" for i in (0, 1)] if g != 9 else None)
            for g in range(3000)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    dealt, packed = grouped_rows(df, ["graphid"], 4)
    few = bundled(dealt).collect()
    assert sorted(r[0] for r in few) == [0, 1, 2, 3]
    found = sorted(_unpacked(few, packed), key=str)
    assert list(map(str, found)) == sorted(map(str, _unpacked(dealt.collect(), packed)))
    assert len(found) == 3000 and found[0].__fields__ == schema.names
    assert bundled(dealt.limit(0)).collect() == []

    handle = _Handle()
    groups = KeyGroups(CompletionProcessor(["graphid"], 1), ["graphid"], packed)
    groups.init(handle)
    assert list(groups.handleInputRows((0,), iter(few), None)) == []
    text = sum(len(p) for r in rows for p in r[3] or [])
    assert len(handle.states["group"].value[0]) < text / 5
    out = list(groups.handleInputRows((0,), iter(few), None))
    assert len(out) == 3000 and sum(len(r["outputs"]) for r in out) == 4 * 2999


def test_a_replay_is_staged_in_parts_and_read_once(spark):
    """The parts of a table are one replay; slices that a consuming stream has
    read are deleted."""
    df = spark.range(300).selectExpr("id % 100 AS t", "id")
    parts = [df.where(F.col("id") % 3 == k) for k in range(3)]
    path, n = write_replay_files(parts, "t", 5)
    assert spark.read.parquet(path).count() == 300

    def files():
        return len(spark.read.parquet(path).inputFiles())

    before = files()
    s = replay_stream(spark, path, df.schema, n, consume=True).select("id")
    got = run_to_table(s, "t-consumed")
    assert sorted(r.id for r in got.collect()) == list(range(300))
    assert files() <= before - 2 * n


def test_declared_tasks_of_odd_orders(spark):
    """Each job of an order declares its highest line number, in one exchange
    of the orders; lines without an order declare nothing."""
    rows = [(1, "F", 1), (1, "F", 3), (1, "O", 2), (2, "O", 1), (2, None, 4), (3, "F", None),
            (None, "F", 7), (3, "O", 1)]
    li = spark.createDataFrame(rows, "l_orderkey bigint, l_linestatus string, l_linenumber int")
    li = li.select("*", F.lit(1).alias("l_shipdate"), *[F.lit(1).alias(c) for c in (
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag")])
    p = payloads_from_lineitem(li)
    assert {(r.graphid, str(r.jobtasks)) for r in p.collect()} == {
        (1, "{'0': 3, '1': 2}"), (2, "{'1': 4}"), (3, "{'0': None, '1': 1}"), (None, "None")}
    plan = p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2
