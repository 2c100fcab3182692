"""Sessions: strict gap, final events, fixed windows, and the ordered scan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions.parse import parse_game_event
from tidepool.operators.ordered import number_rows, number_sessions
from tidepool.operators.sessions import (fixed_windows, session_windows, sessions_with_final,
                                         to_global_window)
from tests.test_scores import GOLDEN, lines


def _final_rows(spark, spec):
    """spec like 'n0 n10 F20' -> rows (k, t seconds, final, id)."""
    rows = []
    for i, tok in enumerate(spec.split()):
        rows.append(("k", int(tok[1:]), tok[0] == "F", i))
    return (spark.createDataFrame(rows, "k string, t long, fin boolean, id long")
                 .withColumn("ts", F.timestamp_seconds("t")))


def _sessions(df, gap=30, partitions=None):
    out = sessions_with_final(df, "k", "ts", gap, F.col("fin"), tiebreak=["id"],
                              partitions=partitions)
    return sorted((r["session_start"].timestamp() if hasattr(r["session_start"], "timestamp") else 0,
                   r["n_events"], r["closed"],
                   int((r["session_end"] - r["session_start"]).total_seconds()))
                  for r in out.collect())


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
def test_sessions_with_final_fixtures(spark, spec, expected):
    got = _sessions(_final_rows(spark, spec))
    assert [(int(s), n, c, d) for s, n, c, d in got] == expected


@pytest.mark.parametrize("spec,expected", [
    ("F0 n10 n100 F200", [(0, 4, True, 200)]),
    ("n0 F10 F15 n99 n300", [(0, 2, True, 10), (15, 3, False, None)]),
    ("n0 n40 F60 n70", [(0, 1, False, 30), (40, 2, True, 20), (70, 1, False, 30)]),
])
def test_a_lone_final_may_absorb(spark, spec, expected):
    out = sessions_with_final(_final_rows(spark, spec), "k", "ts", 30, F.col("fin"),
                              tiebreak=["id"], lone_final="absorb")
    got = sorted((int(r.session_start.timestamp()), r.n_events, r.closed,
                  r.session_end and int((r.session_end - r.session_start).total_seconds()))
                 for r in out.collect())
    base = min(g[0] for g in got) - min(e[0] for e in expected)
    assert [(s - base, *rest) for s, *rest in got] == expected
    with pytest.raises(ValueError):
        sessions_with_final(_final_rows(spark, spec), "k", "ts", 30, F.col("fin"),
                            lone_final="other")


def test_gap_must_be_positive(spark):
    with pytest.raises(ValueError):
        sessions_with_final(_final_rows(spark, "n0"), "k", "ts", 0, F.col("fin"))


def test_golden_strict_sessions(spark):
    ev = parse_game_event(lines(spark, GOLDEN)).withColumn("id", F.monotonically_increasing_id())
    s = session_windows(ev, "user", "event_time", 7200, tiebreak=["score"],
                        aggs=[F.sort_array(F.collect_list("score")).alias("scores")])
    got = sorted((r["user"], list(r["scores"])) for r in s.collect())
    # user4's two events lie exactly 7200 s apart: two sessions
    assert got == [("user1", [14]), ("user1", [18, 18]), ("user2", [2]), ("user3", [3]),
                   ("user3", [5, 8]), ("user4", [2]), ("user4", [5])]
    g = to_global_window(s, "user", [F.sum("n_events").alias("n")])
    assert {r["user"]: r["n"] for r in g.collect()} == {"user1": 3, "user2": 1, "user3": 3, "user4": 2}


def test_session_end_is_last_plus_gap(spark):
    df = _final_rows(spark, "n0 n10 n100")
    s = session_windows(df, "k", "ts", 30, tiebreak=["id"])
    got = sorted((r["n_events"], int((r["session_end"] - r["session_start"]).total_seconds()))
                 for r in s.collect())
    assert got == [(1, 30), (2, 40)]
    assert all(r["event_time"] == r["session_end"] for r in s.collect())


def test_gap_plus_minus_one_microsecond(spark):
    rows = [("k", 0, 0), ("k", 30_000_000 - 1, 1), ("k", 60_000_000 - 1, 2)]
    df = (spark.createDataFrame(rows, "k string, us long, id long")
               .withColumn("ts", F.timestamp_micros("us")))
    s = session_windows(df, "k", "ts", 30, tiebreak=["id"])
    assert sorted(r["n_events"] for r in s.collect()) == [1, 2]


@pytest.mark.parametrize("parts,hot", [(1, 0), (3, 0), (11, 0), (4, 10**9), (4, 300)])
def test_ordered_scan_matches_window_functions(spark, parts, hot):
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        k = 0 if rnd.random() < 0.4 else rnd.randint(1, 25)  # key 0 is hot
        rows.append((i, k, rnd.randint(0, 8000), rnd.random() < 0.05))
    df = (spark.createDataFrame(rows, "id long, k long, t long, fin boolean")
               .withColumn("ts", F.timestamp_seconds("t")))
    a = number_rows(df, ["k"], ["t", "id"], out="rn", partitions=parts, hot_key_rows=hot)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    s = number_sessions(df, ["k"], "ts", 60, tiebreak=["id"], final=F.col("fin"),
                        partitions=parts, hot_key_rows=hot)
    w = Window.partitionBy("k").orderBy("ts", "fin", "id")
    pt, pf = F.lag("t").over(w), F.lag("fin").over(w)
    brk = (pt.isNull() | pf | ((F.col("t") - pt) >= 60)).cast("int")
    s2 = (df.withColumn("b", brk)
            .withColumn("session_seq", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("b"))
    assert s.exceptAll(s2).count() == 0 and s2.exceptAll(s).count() == 0


def test_ordered_scan_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, t long")
    for hot in (0, 10**9):
        got = {(r["k"], r["t"], r["rn"])
               for r in number_rows(df, ["k"], ["t"], partitions=2, hot_key_rows=hot).collect()}
        assert got == {(1, 3, 1), (None, 1, 1), (None, 2, 2)}


def test_fixed_windows(spark):
    df = _final_rows(spark, "n0 n4 n5 n12")
    w = fixed_windows(df, "ts", 5)
    got = sorted(int(r["window"]["start"].timestamp()) for r in w.collect())
    assert got == [0, 0, 5, 10]


def test_ordered_scan_splits_a_group_of_copies(spark):
    # a third of the rows are identical copies: same key, same time
    rows = [(0, 5)] * 600 + [(k, t) for k in range(1, 40) for t in range(30)]
    df = spark.createDataFrame(rows, "k long, t long")
    out = number_rows(df, ["k"], ["t"], partitions=6, hot_key_rows=0)
    got = out.where("k = 0").agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(got) == (1, 600, 600)
    per_part = (df.withColumn("_tp_tie", F.monotonically_increasing_id())
                  .repartitionByRange(6, "k", "t", "_tp_tie")
                  .groupBy(F.spark_partition_id()).count().collect())
    assert max(r["count"] for r in per_part) < 600  # the copies span partitions


def test_ordered_scan_edge_table_without_broadcast(spark, monkeypatch):
    import tidepool.operators.ordered as ordered
    monkeypatch.setattr(ordered, "EDGE_BROADCAST_MAX_ROWS", 0)
    rows = [(k % 3, i) for i, k in enumerate(range(300))] + [(0, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long")
    a = number_rows(df, ["k"], ["t"], partitions=5, hot_key_rows=0)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_absorbing_sessions_of_a_hot_key_are_split(spark):
    import random

    from tidepool.operators.sessions import _absorbing_rows
    rng = random.Random(11)
    rows, t = [], {"hot": 0, None: 0, "cold": 0}
    for i in range(1500):
        k = "hot" if i % 3 else rng.choice([None, "hot"]) if i > 5 else "cold"
        t[k] += rng.choice([0, 5, 20, 29, 30, 31, 90])
        rows.append((k, t[k], rng.random() < 0.08, i))
    want = {}
    for key in t:
        state, seq, before = "idle", 0, 0
        for _, at, final, i in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if state == "opened" and at - before >= 30:
                state = "idle"
            if begins := state == "idle":
                seq, state = seq + 1, "absorbing" if final else "opened"
            elif final:
                state = "idle"
            want[i], before = (seq, final and not begins, final and begins), at
    df = spark.createDataFrame(rows, "k string, at long, _final boolean, id long").selectExpr(
        "k", "timestamp_seconds(at) ts", "_final", "id").repartition(3)
    got = _absorbing_rows(df, ["k"], "ts", 30, ["id"]).selectExpr(
        "*", "spark_partition_id() part").collect()
    assert {r.id: (r.session_seq, r._ends, r._lone) for r in got} == want and len(got) == 1500
    assert len({r.part for r in got if r.k == "hot"}) > 1
