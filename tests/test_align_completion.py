"""sync, flatten and job_output."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators.align import flatten, sync
from tidepool.operators.completion import job_output, job_output_all_levels
from tidepool.session import session_settings
from tidepool.sources.payloads import work_payloads


def kv(spark, rows, vtype="bigint"):
    return spark.createDataFrame(
        [(k, v, t, i) for i, (k, v, t) in enumerate(rows)],
        f"key string, value {vtype}, arrival_ts long, arrival_id long")


def test_documented_example(spark):
    a = kv(spark, [("k1", 1, 0), ("k2", 2, 1), ("k3", 3, 2)])
    b = kv(spark, [("k1", 4, 0), ("k2", 5, 1), ("k3", 6, 2)])
    got = sorted((r["key"], r["value_0"], r["value_1"]) for r in sync([a, b]).collect())
    assert got == [("k1", 1, 4), ("k2", 2, 5), ("k3", 3, 6)]


def test_missing_key_and_modes(spark):
    a = kv(spark, [("k1", 1, 0), ("k2", 2, 1)])
    b = kv(spark, [("k1", 4, 0)], "string")
    assert [r["key"] for r in sync([a, b]).collect()] == ["k1"]
    longest = sorted((r["key"], r["value_1"]) for r in sync([a, b], mode="longest").collect())
    assert longest == [("k1", "4"), ("k2", None)]
    assert sync([a, b], mode="shortest").count() == 1


def test_occurrence_vs_arrival(spark):
    # two values of k from input a before input b's first
    a = kv(spark, [("k", 1, 0), ("k", 2, 1)])
    b = kv(spark, [("k", 9, 5)])
    occ = sync([a, b], match="occurrence").collect()
    assert [(r["value_0"], r["value_1"]) for r in occ] == [(1, 9)]
    arr = sync([a, b], match="arrival").collect()
    assert len(arr) == 1
    assert [(i["src"], i["value_0"]) for i in arr[0]["items"]] == [(0, 1), (0, 2)]


def test_sync_validation(spark):
    a = kv(spark, [("k", 1, 0)])
    with pytest.raises(ValueError):
        sync(a)
    with pytest.raises(ValueError):
        sync([a], mode="bogus")
    with pytest.raises(ValueError):
        sync([])


def test_flatten_keeps_duplicates(spark):
    a = spark.range(1, 5)
    b = spark.range(3, 10)
    got = sorted(r["id"] for r in flatten(a, b).collect())
    assert got == [1, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9]
    assert sorted(r["id"] for r in flatten([spark.range(1, 5), spark.range(5, 10)]).collect()) \
        == list(range(1, 10))


ARR = ["arrival"]


def test_farm_set_all_levels(spark):
    p = work_payloads(spark, graphs=1, jobs=2, tasks=3, outputs=4, seed=3)
    tasks = job_output(p, "taskid").collect()
    assert len(tasks) == 6 and all(len(r["outputs"]) == 4 for r in tasks)
    jobs = job_output(p, "jobid", arrival=ARR).collect()
    assert sorted(len(r["outputs"]) for r in jobs) == [12, 12]
    graphs = job_output(p, "graphid", arrival=ARR).collect()
    assert [len(r["outputs"]) for r in graphs] == [24]
    # outputs follow arrival order
    order = [r["output"] for r in p.orderBy("arrival").collect()]
    assert graphs[0]["outputs"] == [x for o in order for x in o]
    allv = job_output_all_levels(p, ARR).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in allv} == {"taskid": 6, "jobid": 2, "graphid": 1}


def test_missing_payload_never_fires(spark):
    p = work_payloads(spark, graphs=1, jobs=2, tasks=3, outputs=1, seed=1)
    p = p.where(~((F.col("jobid") == 0) & (F.col("taskid") == 1)))
    assert [r["jobid"] for r in job_output(p, "jobid", arrival=ARR).collect()] == [1]
    assert job_output(p, "graphid", arrival=ARR).count() == 0


def test_twice_the_payloads_fire_twice(spark):
    p = work_payloads(spark, graphs=1, jobs=2, tasks=3, outputs=1, seed=1)
    p2 = p.unionByName(p.withColumn("arrival", F.col("arrival") + 100))
    g = job_output(p2, "graphid", arrival=ARR).collect()
    assert sorted(r["fire"] for r in g) == [1, 2]


def test_equal_job_ids_of_two_graphs(spark):
    p = work_payloads(spark, graphs=2, jobs=1, tasks=2, outputs=1, seed=5)
    # default key (graphid, jobid): each graph's job completes on its own
    assert job_output(p, "jobid", arrival=ARR).count() == 2
    # the reference keys by jobid alone: four payloads against two declared
    assert job_output(p, "jobid", arrival=ARR, scope="jobid").count() == 2
    one = p.where(~((F.col("graphid") == 1) & (F.col("taskid") == 1)))
    assert job_output(one, "jobid", arrival=ARR).count() == 1
    assert job_output(one, "jobid", arrival=ARR, scope="jobid").count() == 1


def test_levels_of_one_feed_equal_each_level(spark):
    p = work_payloads(spark, graphs=3, jobs=2, tasks=3, outputs=1, seed=2)
    p = p.where(~((F.col("graphid") == 0) & (F.col("jobid") == 1) & (F.col("taskid") == 2)))
    p = p.unionByName(p.where("graphid = 2").withColumn("arrival", F.col("arrival") + 1000))
    # a key whose payloads declare changing numbers
    p = p.withColumn("jobtasks", F.when(
        (F.col("graphid") == 1) & (F.col("taskid") == 0),
        F.transform_values("jobtasks", lambda _, n: n - 1)).otherwise(F.col("jobtasks")))
    for scope in ("graph", "jobid"):
        got = job_output_all_levels(p, ARR, scope=scope).collect()
        for level in ("jobid", "graphid"):
            alone = job_output(p, level, arrival=ARR, scope=scope)
            keys = [c for c in ("graphid", "jobid", "fire", "n_payloads", "outputs")
                    if c in alone.columns]
            rows = sorted(tuple(map(str, r)) for r in alone.select(*keys).collect())
            assert rows and rows == sorted(tuple(str(r[c]) for c in keys)
                                           for r in got if r["level"] == level)


def test_levels_share_one_exchange_and_join_no_counts(spark):
    p = work_payloads(spark, graphs=4, jobs=2, tasks=3, outputs=2, seed=6)
    p = p.where(~((F.col("graphid") == 0) & (F.col("taskid") == 2)))
    p = p.unionByName(p.where("graphid = 3").withColumn("arrival", F.col("arrival") + 1000))
    changed = F.when((F.col("graphid") == 1) & (F.col("taskid") == 0),
                     F.transform_values("jobtasks", lambda _, n: n - 1)).otherwise(F.col("jobtasks"))
    no_broadcast = {"spark.sql.adaptive.enabled": "false",
                    "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for rows, apart in ((p, False), (p.withColumn("jobtasks", changed), True)):
        slow = sorted(map(str, job_output_all_levels(rows, ARR).collect()))  # hot keys from 3 rows on
        with session_settings(spark, {"tidepool.hotKeyRows": "1000", **no_broadcast}):
            got = job_output_all_levels(rows, ARR)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, got.collect())) == slow and slow
        if not apart:
            assert plan.count("Exchange hashpartitioning") == 1
            assert "completion-counts" not in plan


def test_level_validation(spark):
    p = work_payloads(spark, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        job_output(p, "bogus")
    with pytest.raises(ValueError):
        job_output(p, "jobid")  # stateful levels need an arrival order
