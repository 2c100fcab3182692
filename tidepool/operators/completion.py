"""Completion of work payloads: emit a task's, a job's or a graph's outputs
once all its declared parts have arrived.

A payload is ``(graphid, jobtasks MAP<STRING,INT>, jobid, taskid, output
ARRAY<STRING>)``. Per key, payloads are counted in arrival order; when the
count reaches the number that the payload just counted declares, the outputs
collected so far are emitted and the count starts again (so twice the declared
payloads fire twice; an incomplete key never fires). A NULL output adds
nothing, a NULL declared number never fires. A job declares ``jobtasks[jobid]`` parts, a graph
the sum of all ``jobtasks`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.contracts import require_columns
from tidepool.operators.ordered import EDGE_BROADCAST_MAX_ROWS, hot_key_threshold, number_rows
from tidepool.session import dropped, written

GRAPH, JOB, TASK = "graphid", "jobid", "taskid"
STATEFUL = (JOB, GRAPH)
STATELESS = (TASK,)
LEVELS = (GRAPH, JOB, TASK)


def declared_parts(level: str) -> F.Column:
    """How many payloads complete a key of ``level``."""
    if level == JOB:
        jt = F.col("jobtasks")[F.col("jobid").cast("string")]
        return F.when(jt.isNull(), F.raise_error(F.concat(
            F.lit("jobtasks has no entry for job "), F.col("jobid").cast("string")))) \
                .otherwise(jt).cast("bigint")
    if level == GRAPH:
        return F.aggregate(F.map_values("jobtasks"), F.lit(0).cast("bigint"),
                           lambda a, x: a + x.cast("bigint"))
    raise ValueError(f"level {level!r} has no declared count")


def level_keys(level: str, scope: str = "graph") -> list[str]:
    if level == GRAPH:
        return [GRAPH]
    if level == JOB:
        # The reference keys jobs by jobid alone, so equal job ids of two
        # graphs share one counter; scope="jobid" keeps that behaviour.
        return [GRAPH, JOB] if scope == "graph" else [JOB]
    if level == TASK:
        return [GRAPH, JOB, TASK]
    raise ValueError(f"level must be one of {LEVELS}")


def _same(keys: Sequence[str], names: Sequence[str]) -> list[F.Column]:
    return [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]


def _firings(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., _end, fire)`` (a written table): the links on the path of a
    key that begins at row 0, and their numbers along it.

    A link ``(keys..., _start, _end)`` says: if a count begins after row
    ``_start``, it is reached at row ``_end``. Every end has one start, so the
    links of a key form paths. Each link jumps back over twice as many links
    per round, until it is at row 0 or at a row where no count ends (such a
    path is never entered). A round is one join on (key, row): the links of a
    hot key are dealt like all others, and rounds grow with the logarithm of
    the longest path."""
    names = [f"_j{i}" for i in range(len(keys))]
    jumps = written(links.select(*keys, "_end", F.col("_start").alias("_at"),
                                 F.lit(1).cast("bigint").alias("fire")), "completion-jumps")
    while not jumps.where("_at > 0").isEmpty():
        known = jumps.toDF(*names, "_known", "_next", "_more")
        moved = jumps.where("_at > 0").join(
            known, [*_same(keys, names), F.col("_at") == F.col("_known")]).select(
            *keys, "_end", F.col("_next").alias("_at"), (F.col("fire") + F.col("_more")).alias("fire"))
        further = written(jumps.where("_at = 0").unionByName(moved), "completion-jumps")
        dropped(jumps)
        jumps = further
    return jumps


_DECLARED = {"_emin": F.min, "_emax": F.max, "_known": F.count}


def _counted(payloads: DataFrame, levels: Sequence[str], scope: str) -> dict[str, DataFrame]:
    """Per level a written table ``(keys..., _n, _emin, _emax, _known)``: the
    payloads of each key, the least and greatest number they declare and how
    many declare one. The payloads are read once, counted by the keys of all
    levels; a level with fewer keys adds these counts up."""
    every = list(dict.fromkeys(k for level in levels for k in level_keys(level, scope)))
    p = payloads.select(*every, *[declared_parts(level).alias(f"_{level}") for level in levels])
    finest = written(p.groupBy(*every).agg(F.count(F.lit(1)).alias("_n"), *[
        f(f"_{level}").alias(name + level) for level in levels for name, f in _DECLARED.items()]),
        "completion-counts")
    out = {}
    for level in levels:
        keys = level_keys(level, scope)
        own = finest.select(*keys, "_n", *[F.col(name + level).alias(name) for name in _DECLARED])
        out[level] = own if set(keys) == set(every) else written(own.groupBy(*keys).agg(
            F.sum("_n").alias("_n"), F.min("_emin").alias("_emin"),
            F.max("_emax").alias("_emax"), F.sum("_known").alias("_known")), "completion-counts")
    return out


def _one_number() -> F.Column:
    """Of a key's counts: whether all its payloads declare one number."""
    return F.coalesce((F.col("_emin") == F.col("_emax")) & (F.col("_known") == F.col("_n")),
                      F.lit(False))


def _apart(of_key: DataFrame) -> DataFrame:
    """The keys of a table of :func:`_counted` that a plain window cannot
    take: too many payloads for one task, or changing numbers."""
    hot = F.col("_n") > F.lit(hot_key_threshold(of_key.sparkSession))
    return of_key.where(hot | ~_one_number())


def _without(rows: DataFrame, keys: Sequence[str], of_key: DataFrame
             ) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of the keys not in ``of_key``, and of the keys in it (None if
    it is empty). A few keys are broadcast."""
    n = of_key.count()
    if not n:
        return rows, None
    names = [f"_a{i}" for i in range(len(keys))]
    some = of_key.select(*keys).toDF(*names)
    if n <= EDGE_BROADCAST_MAX_ROWS:
        some = F.broadcast(some)
    return (rows.join(some, _same(keys, names), "left_anti"),
            rows.join(some, _same(keys, names), "left_semi"))


def _runs(size: F.Column) -> list[F.Column]:
    """``fire``, ``place`` and ``n_payloads`` from a payload's number ``_rn``
    among the ``_n`` of its key, where all of them declare ``size``."""
    size = F.when(size > 0, size)
    fire = F.floor((F.col("_rn") - 1) / size).cast("bigint") + 1
    done = fire * size <= F.col("_n")
    return [F.when(done, fire).alias("fire"),
            F.when(done, F.col("_rn") - (fire - 1) * size).alias("place"),
            F.when(done, size).alias("n_payloads")]


def _windowed(p: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """``p`` with its numbers ``_rn`` and ``_n`` per key, for keys that fit a
    task: rows are not joined with the counts of their keys, so they move
    once at most."""
    w = Window.partitionBy(*keys)
    return p.select("*", F.row_number().over(w.orderBy(*arrival)).cast("bigint").alias("_rn"),
                    F.count(F.lit(1)).over(w).alias("_n"))


def _numbered_payloads(p: DataFrame, of_key: DataFrame, keys: list[str], arrival: Sequence[str],
                       partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """``p`` (with ``_expected``), numbered per key as ``_rn``, in two parts
    with ``fire``, ``place`` and ``n_payloads`` (all NULL where no firing is
    complete): keys whose payloads declare one number, and the others.
    ``of_key`` is the level's table of :func:`_counted`; only its hot keys and
    those with changing numbers are joined with payloads."""
    names = [f"_k{i}" for i in range(len(keys))]
    apart = _apart(of_key)
    plain, odd = _without(p, keys, apart)
    plain = _windowed(plain, keys, arrival)
    steady = plain.select(*p.columns, "_rn", *_runs(F.col("_expected")))
    if odd is None:
        return steady, steady.limit(0)
    renamed = apart.toDF(*names, "_n", "_emin", "_emax", "_known")
    numbered = number_rows(odd, keys, list(arrival), out="_rn", partitions=partitions,
                           counts=apart).join(renamed, _same(keys, names))
    one = _one_number()
    steady = steady.unionByName(numbered.where(one).select(
        *p.columns, "_rn", *_runs(F.col("_emax"))))
    if apart.where(~one).isEmpty():
        return steady, steady.limit(0)
    varied = written(numbered.where(~one).select(*p.columns, "_rn"), "completion-varied")
    start = F.col("_rn") - F.col("_expected")
    links = written(varied.where((F.col("_expected") > 0) & (start >= 0))
                    .groupBy(*keys, start.alias("_start")).agg(F.min("_rn").alias("_end")),
                    "completion-links")
    spans = links.toDF(*names, "_start", "_stop")
    firings = _firings(links, keys)
    span = firings.join(spans, [*_same(keys, names), F.col("_end") == F.col("_stop")]).select(
        *names, "fire", (F.col("_end") - F.col("_start")).alias("n_payloads"),
        F.explode(F.sequence(F.col("_start") + 1, F.col("_end"))).alias("_row"),
        F.col("_start").alias("_from"))
    # the spans of a key do not overlap: a row meets one at most
    changed = varied.join(span, [*_same(keys, names), F.col("_rn") == F.col("_row")], "left").select(
        *p.columns, "_rn", "fire", (F.col("_rn") - F.col("_from")).alias("place"), "n_payloads")
    return steady, changed


def job_output_rows(payloads: DataFrame, level: str = GRAPH, arrival: Sequence[str] = (),
                    scope: str = "graph", partitions: int | None = None,
                    counts: DataFrame | None = None) -> DataFrame:
    """The payloads of complete firings, ``(keys..., fire, place, n_payloads,
    output)``: ``fire`` counts the firings of the key, ``place`` the payloads
    of a firing from 1. Nothing is gathered: payloads are numbered per key
    (skew-safe), and whether a firing is complete follows from counts.

    Where all payloads of a key declare one number, firings are runs of that
    length. Where the numbers of a key change, a count that begins after row s
    is reached at the first row r that declares r - s; these links are
    followed from row 0 by pointer doubling, in joins of written tables that
    split a hot key. ``counts`` is the level's table of :func:`_counted`, if
    it is at hand."""
    keys = level_keys(level, scope)
    # only what the count and the output need travels through the scan
    p = payloads.select(*keys, *[c for c in arrival if c not in keys],
                        declared_parts(level).alias("_expected"), "output")
    if counts is None:
        counts = _counted(payloads, [level], scope)[level]
    steady, varied = _numbered_payloads(p, counts, keys, arrival, partitions)
    return steady.unionByName(varied).where(F.col("fire").isNotNull()).select(
        *keys, "fire", "place", "n_payloads", "output")


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    return (rows.groupBy(*keys, "fire")
                .agg(F.max("n_payloads").alias("n_payloads"), F.sort_array(F.collect_list(
                    F.struct("place", F.coalesce("output", none).alias("output")))).alias("_o"))
                .select(*keys, "fire", "n_payloads",
                        F.flatten(F.col("_o")["output"]).alias("outputs")))


def ready_keys(payloads: DataFrame, level: str = GRAPH, scope: str = "graph") -> DataFrame:
    """The keys of a stateful level that may fire: those with as many payloads
    as one of them declares. No other key has a complete firing."""
    keys = level_keys(level, scope)
    declared = F.col("_expected")
    return (payloads.select(*keys, declared_parts(level).alias("_expected")).groupBy(*keys)
                    .agg(F.count(F.lit(1)).alias("_n"),
                         F.min(F.when(declared > 0, declared)).alias("_emin"))
                    .where(F.col("_n") >= F.col("_emin")).select(*keys))


def job_output_and_rest(payloads: DataFrame, level: str = GRAPH, arrival: Sequence[str] = (),
                        scope: str = "graph", partitions: int | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """:func:`job_output` of a stateful level, and the payloads in no complete
    firing: those that payloads still to come may complete."""
    keys = level_keys(level, scope)
    p = payloads.withColumn("_expected", declared_parts(level))
    of_key = _counted(payloads, [level], scope)[level]
    steady, varied = _numbered_payloads(p, of_key, keys, arrival, partitions)
    rows = written(steady.unionByName(varied), "completion-rows")
    done = F.col("fire").isNotNull()
    return _gathered(rows.where(done), keys), rows.where(~done).select(*payloads.columns)


def job_output(payloads: DataFrame, level: str = GRAPH, arrival: Sequence[str] = (),
               scope: str = "graph", partitions: int | None = None,
               counts: DataFrame | None = None) -> DataFrame:
    """Outputs per completed task / job / graph.

    ``taskid``: each payload's outputs as they are, ``(graphid, jobid,
    taskid, outputs)``. ``jobid`` / ``graphid``: one row per firing,
    ``(keys..., fire, n_payloads, outputs)`` with outputs in arrival order;
    ``fire`` counts firings of the key. ``arrival`` is the arrival order
    (end it with unique columns). A firing's outputs are gathered only once
    it is known to be complete; for firings too large for a row take
    :func:`job_output_rows`.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if scope not in ("graph", "jobid"):
        raise ValueError("scope must be 'graph' or 'jobid'")
    require_columns(payloads, GRAPH, JOB, TASK, "jobtasks", "output", *arrival,
                    where="job_output")
    if level == TASK:
        return payloads.select(GRAPH, JOB, TASK, F.col("output").alias("outputs"))
    if not arrival:
        raise ValueError("stateful levels need an arrival order")
    keys = level_keys(level, scope)
    rows = job_output_rows(payloads, level, arrival, scope, partitions, counts)
    return _gathered(rows, keys)


_LEVEL_COLUMNS = (GRAPH, JOB, TASK, "fire", "n_payloads")


def _leveled(out: DataFrame, level: str) -> DataFrame:
    """``out`` of one level with a ``level`` column, absent columns NULL."""
    return out.select(F.lit(level).alias("level"), *[
        (F.col(c) if c in out.columns else F.lit(None)).cast("bigint").alias(c)
        for c in _LEVEL_COLUMNS], "outputs")


def _both_levels(payloads: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Graph and job outputs of graphs without hot keys and changing numbers.
    A graph's payloads meet once: both levels number them there and gather
    them there."""
    p = payloads.select(GRAPH, JOB, *[c for c in arrival if c not in (GRAPH, JOB)],
                        *[declared_parts(level).alias(f"_{level}") for level in STATEFUL], "output")
    for level in (GRAPH, JOB):
        p = _windowed(p, level_keys(level), arrival).withColumn(f"_of_{level}", F.struct(
            F.lit(level).alias("level"),
            (F.col(JOB) if level == JOB else F.lit(None)).cast("bigint").alias("_job"),
            *_runs(F.col(f"_{level}")))).drop("_rn", "_n")
    rows = p.select(GRAPH, "output", F.explode(F.array(*[f"_of_{x}" for x in STATEFUL])).alias("_of"))
    rows = rows.where(F.col("_of.fire").isNotNull()).select(
        GRAPH, "output", "_of.level", F.col("_of._job").alias(JOB), "_of.fire", "_of.place",
        "_of.n_payloads")
    return _gathered(rows, ["level", GRAPH, JOB])


def job_output_all_levels(payloads: DataFrame, arrival: Sequence[str],
                          scope: str = "graph", partitions: int | None = None) -> DataFrame:
    """Task, job and graph outputs of one feed, as one DataFrame with a
    ``level`` column (absent keys NULL; ``fire`` NULL for tasks). The keys of
    all levels are counted in one pass. Jobs lie within graphs, so both levels
    then share one exchange of the feed; only graphs with a hot key or with
    changing numbers, and all graphs if jobs are keyed across them, are taken
    level by level."""
    counts = _counted(payloads, STATEFUL, scope)
    res = _leveled(job_output(payloads, TASK), TASK)
    odd = payloads
    if scope == "graph":
        require_columns(payloads, *arrival, where="job_output_all_levels")
        if not arrival:
            raise ValueError("stateful levels need an arrival order")
        apart = [_apart(counts[level]).select(GRAPH) for level in STATEFUL]
        plain, odd = _without(payloads, [GRAPH], apart[0].union(apart[1]).distinct())
        both = _both_levels(plain, arrival)
        res = res.unionByName(both.select("level", *[
            (F.col(c) if c in both.columns else F.lit(None)).cast("bigint").alias(c)
            for c in _LEVEL_COLUMNS], "outputs"))
    if odd is not None:
        for level in (JOB, GRAPH):
            res = res.unionByName(_leveled(
                job_output(odd, level, arrival, scope, partitions, counts[level]), level))
    return res
