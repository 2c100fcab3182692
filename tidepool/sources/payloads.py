"""Work payloads: every task of every job of every graph, with its outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_payloads(spark: SparkSession, graphs: int = 1, jobs: int = 2, tasks: int = 3,
                  outputs: int = 2, seed: int = 0) -> DataFrame:
    """``graphs x jobs x tasks`` payloads ``(graphid, jobtasks, jobid, taskid,
    output, arrival)``. Each job declares ``tasks`` tasks; each task wrote
    ``outputs`` paths ``/beam/graph-{g}/job-{j}_output-{i}.task-{t}.ext``.
    ``arrival`` is a seeded hash: a shuffled but repeatable arrival order.

    Built from one ``range`` (no cross join): the row number is split into
    graph, job and task, so the payloads are generated in parallel.
    """
    if min(graphs, jobs, tasks) < 1 or outputs < 0:
        raise ValueError("graphs, jobs and tasks must be >= 1, outputs >= 0")
    n = graphs * jobs * tasks
    i = F.col("id")
    g = (i / (jobs * tasks)).cast("int")
    j = ((i / tasks).cast("bigint") % jobs).cast("int")
    t = (i % tasks).cast("int")
    jobtasks = F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.lit(jobs - 1)), lambda x: x.cast("string")),
        F.array_repeat(F.lit(tasks), jobs))
    paths = F.transform(
        F.sequence(F.lit(0), F.lit(outputs - 1)) if outputs else F.array().cast("array<int>"),
        lambda k: F.format_string("/beam/graph-%d/job-%d_output-%d.task-%d.ext",
                                  F.col("graphid"), F.col("jobid"), k, F.col("taskid")))
    return (spark.range(n)
                 .select(g.alias("graphid"), j.alias("jobid"), t.alias("taskid"), "id")
                 .select("graphid", jobtasks.alias("jobtasks"), "jobid", "taskid",
                         paths.alias("output"),
                         F.xxhash64(F.col("id"), F.lit(seed)).alias("arrival")))
