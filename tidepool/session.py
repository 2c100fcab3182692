"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# transformWithState keeps several state variables per key: it needs RocksDB.
# Only the changes of a micro-batch are committed, snapshots are taken in the
# background.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Shuffle files go when the statement that wrote them ends, not when the driver
# happens to collect its garbage: for statements whose result is a table.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Settings every job of the library relies on. Event times are compared and
# printed in UTC; AQE re-plans joins and coalesces small shuffles at run time;
# keyed streaming state lives in RocksDB (required by transformWithState).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **STATE_STORE,
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tidepool",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    ``master`` is only for local runs and tests; on a cluster leave it unset
    and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """``settings`` hold inside; the session's own come back on leaving. A
    streaming query keeps the settings it was started with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _is_local_path(path: str) -> bool:
    return path.startswith(("/", "file:"))


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A cluster must name a folder every executor can reach; the library never
    invents one there, and refuses a ``fallback`` on a local disk. Only when
    nothing is configured and the session is local (tests, a laptop: its one
    JVM is every executor) is ``fallback`` - or a fresh temporary folder -
    installed as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if re.match(r"local(\[|$)", sc.master):
        fallback = fallback or tempfile.mkdtemp(prefix="tidepool-ckpt-")
    elif fallback is None or _is_local_path(fallback):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a folder all executors share")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's files."""
    root = checkpoint_root(spark)
    return os.path.join(root.rstrip("/"), "tidepool", f"{name}-{uuid.uuid4().hex}")


_LIVE: dict[str, SparkSession] = {}  # scratch tables of this driver, oldest first


def claimed_path(spark: SparkSession, name: str) -> str:
    """A scratch folder that :func:`dropped` may delete."""
    path = scratch_path(spark, name)
    _LIVE[path] = spark
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read
    back: later steps share it and a lost executor does not redo it.
    ``options`` are the writer's."""
    spark = df.sparkSession
    path = claimed_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame | str) -> None:
    """Delete scratch tables (or paths) that nothing unwritten depends on."""
    for t in tables:
        path = t if isinstance(t, str) else t.scratch
        spark = _LIVE.pop(path, None)
        if spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def live_tables() -> list[str]:
    """Paths of the scratch tables not dropped yet, oldest first. A result
    that is still lazy may read them: drop what a call left (those not listed
    before it) once its result is written."""
    return list(_LIVE)


@contextlib.contextmanager
def scratch_scope():
    """Delete on leaving what was written to the scratch folder inside: call
    an operator and write its result in the scope."""
    before = set(_LIVE)
    try:
        yield
    finally:
        dropped(*[t for t in _LIVE if t not in before])
