"""One stream, several branches: every micro-batch goes to all of them.

The stream is read once. A branch takes the rows of a micro-batch and returns
what to append to its table, and may carry rows over to the next micro-batch
(state, as a table). Everything a micro-batch writes lies under its id and is
overwritten if the micro-batch runs again, so a failure between two branches
or before the commit doubles nothing and loses nothing.

What a ``KeyedBranch`` carries is neither moved nor written again while its key
waits: a micro-batch finds the keys that may go on (``ready``) and marks their
hashes in a bitmap; the branch runs over the rows whose key is marked, and all
other new rows are appended to what is carried. The bitmaps of later
micro-batches say which rows of an older part have left it. A key of the same
hash as a ready one is run too, which changes nothing: it comes back as rest.
Every ``PARTS``-th micro-batch writes what is carried as one part again.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import dropped, live_tables, written

# rows -> (rows to append, rows to carry over or None)
Branch = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]

# Bits of a bitmap (8 MB at most; with more ready keys than a few
# million, more waiting keys are run with them), bits of a block of it (what
# Spark's bitmap functions hold) and the parts that rows carried over lie in.
READY_BITS, BLOCK_BITS, PARTS = 26, 15, 8


@dataclass(frozen=True)
class KeyedBranch:
    """A branch whose rows matter to their own key only. ``ready`` takes all
    rows (carried and new) and returns ``keys`` of those that ``run`` may do
    something for; ``run`` of any other key would only carry its rows over."""

    keys: list[str]
    ready: Callable[[DataFrame], DataFrame]
    run: Branch


def _bit(keys: list[str]):
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << READY_BITS))
    return F.shiftright(h, BLOCK_BITS), h.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _bitmap(ready: DataFrame, keys: list[str]) -> DataFrame:
    block, bit = _bit(keys)
    return ready.groupBy(block.alias("tp_block")).agg(F.bitmap_construct_agg(bit).alias("tp_bits"))


def _marked(rows: DataFrame, keys: list[str], bitmap: DataFrame, marked: bool) -> DataFrame:
    """The rows whose key is marked, or those whose key is not."""
    block, bit = _bit(keys)
    # fixed values: a byte has 8 bits, two hex digits
    byte = F.conv(F.hex(F.substring("tp_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10)
    is_set = F.expr("tp_byte >> tp_at & 1") == 1
    return (rows.withColumn("tp_block", block).join(F.broadcast(bitmap), "tp_block", "left")
                .withColumns({"tp_byte": byte.cast("int"),
                              "tp_at": bit.bitwiseAND(F.lit(7)).cast("int")})
                .where(F.coalesce(is_set, F.lit(False)) == F.lit(marked))
                .select(*rows.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run_fan_out(stream: DataFrame, branches: dict[str, Branch | KeyedBranch], path: str
                ) -> dict[str, DataFrame]:
    """Run ``stream`` until drained through all ``branches`` and return their
    tables. ``path`` (in a folder all executors share) holds the tables, the
    rows carried over and the checkpoint; called again with it, the stream
    goes on where it stopped. A carried row has the columns of the stream."""
    spark = stream.sparkSession

    def carried(name: str, batch_id: int) -> str:
        return os.path.join(path, name, "carried", str(batch_id))

    def marks(name: str, batch_id: int) -> str:
        return os.path.join(path, name, "ready", str(batch_id))

    def put(rows: DataFrame, at: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(at)

    def keyed(name: str, branch: KeyedBranch, batch: DataFrame, batch_id: int) -> None:
        first = max(batch_id - 1, 0) // PARTS * PARTS
        parts = []
        for i in range(first, batch_id):
            rows = spark.read.schema(batch.schema).parquet(carried(name, i))
            for j in range(i + 1, batch_id):
                rows = _marked(rows, branch.keys, spark.read.parquet(marks(name, j)), False)
            parts.append(rows)
        rows = reduce(DataFrame.unionByName, [*parts, batch])
        ready = written(branch.ready(rows).select(*branch.keys), "fan-out-ready")
        put(_bitmap(ready, branch.keys).coalesce(1), marks(name, batch_id))
        now = spark.read.parquet(marks(name, batch_id))
        out, rest = branch.run(_marked(rows, branch.keys, now, True))
        put(out, os.path.join(path, name, "out", f"batch={batch_id}"))
        waiting = rows if batch_id % PARTS == 0 else batch
        put(rest.select(*batch.columns).unionByName(_marked(waiting, branch.keys, now, False)),
            carried(name, batch_id))
        # only the last micro-batch can run again: it needs the parts before
        for i in range(max(first - PARTS, 0), first):
            _delete(spark, carried(name, i))
            _delete(spark, marks(name, i))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, branch in branches.items():
                before = set(live_tables())
                if isinstance(branch, KeyedBranch):
                    keyed(name, branch, batch, batch_id)
                    dropped(*[t for t in live_tables() if t not in before])
                    continue
                rows = batch
                if _exists(spark, carried(name, batch_id - 1)):
                    rows = spark.read.schema(batch.schema).parquet(
                        carried(name, batch_id - 1)).unionByName(batch)
                out, rest = branch(rows)
                put(out, os.path.join(path, name, "out", f"batch={batch_id}"))
                if rest is not None:
                    put(rest.select(*batch.columns), carried(name, batch_id))
                    # only the last micro-batch can run again: it needs one before
                    _delete(spark, carried(name, batch_id - 2))
                dropped(*[t for t in live_tables() if t not in before])
        finally:
            batch.unpersist()

    q = (stream.writeStream.foreachBatch(write)
               .option("checkpointLocation", os.path.join(path, "checkpoint"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
    found = {}
    for name, branch in branches.items():
        out = os.path.join(path, name, "out")
        if _exists(spark, out):
            found[name] = spark.read.option("basePath", out).parquet(out).drop("batch")
        else:  # no micro-batch yet
            run = branch.run if isinstance(branch, KeyedBranch) else branch
            found[name] = run(spark.createDataFrame([], stream.schema))[0].where(F.lit(False))
    return found
