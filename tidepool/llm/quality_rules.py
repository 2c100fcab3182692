"""Quality rules with an isolation forest over rule statistics.

Fixed rules reject texts that are too short or mostly repetition. The other
texts are judged by an isolation forest: in trees of random splits over the
rule statistics, unusual documents are cut off after few splits. The path
length below which a document is rejected is calibrated on labelled rows.
All labelled rows count: the splits are drawn over the range of their
statistics, Spark adds up over all good rows how many end in each node, and
over all rows how path lengths are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import lean_task
from tidepool.llm.labels import known_labels
from tidepool.llm.statistics import COUNTS, RATIOS, document_statistics
from tidepool.session import dropped, written

# Every tree counts all good rows (no bound on them).
TREES, TREE_ROWS, DEPTH = 150, None, 10
NODES = 2 ** (DEPTH + 1) - 1
# Path lengths are told apart in steps of this size to set the threshold: the
# driver sees a count per step, however many rows there are.
STEP = 1 / 4096
# The statistics the trees split on (their square roots: most are near 0).
RULES = ("symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share",
         "bang_per_word", "pipe_per_word", "top_word_share")
# Of labelled good rows, at most this share may fall below the threshold.
GOOD_LOSS = 0.002
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _usual_depth(n) -> np.ndarray:
    """Mean depth at which a search in a random binary tree of n rows ends."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(safe - 1 + 1e-12) + np.euler_gamma)
                    - 2 * (safe - 1) / safe) * (n > 1)


def _rule_values(ratios: np.ndarray) -> np.ndarray:
    return np.sqrt(ratios[:, [RATIOS.index(r) for r in RULES]])


class IsolationForest:
    """Trees of random splits, as arrays: node k has children 2k+1 and 2k+2;
    ``feature`` is -1 at a leaf, ``path`` is the leaf's depth plus the usual
    depth of the rows that ended there.

    A split is drawn evenly over the box of its node, which starts as the
    range of all labelled rows, so that values no good row has still get cut
    off - early, as their boxes are empty. The splits need that range only
    (:meth:`drawn`); a node in which less than two good rows end is a leaf
    (:meth:`counted`), and its children are not entered."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        self._draw(low, high, seed)
        self.counted(self.ends(good))

    @classmethod
    def drawn(cls, low: np.ndarray, high: np.ndarray, seed: int = 7) -> IsolationForest:
        """The splits, of all nodes above the last depth."""
        forest = cls.__new__(cls)
        forest._draw(low, high, seed)
        return forest

    def _draw(self, low, high, seed) -> None:
        rng = np.random.default_rng(seed)
        self.feature = np.full((TREES, NODES), -1, dtype=np.int32)
        self.cut = np.zeros((TREES, NODES))
        self.path = np.zeros((TREES, NODES))
        a, b = (np.tile(np.asarray(x, dtype=np.float64), (TREES, 1, 1)) for x in (low, high))
        for depth in range(DEPTH):
            wide = 1 << depth
            own = slice(wide - 1, 2 * wide - 1)
            able = b > a
            nth = np.floor(rng.random((TREES, wide)) * able.sum(axis=2))
            f = np.argmax(np.cumsum(able, axis=2) > nth[..., None], axis=2)
            at = f[..., None]
            lo, hi = (np.take_along_axis(x, at, axis=2)[..., 0] for x in (a, b))
            cut = lo + rng.random((TREES, wide)) * (hi - lo)
            self.feature[:, own] = np.where(able.any(axis=2), f, -1)
            self.cut[:, own] = cut
            below, above = b.copy(), a.copy()
            np.put_along_axis(below, at, cut[..., None], axis=2)
            np.put_along_axis(above, at, cut[..., None], axis=2)
            a, b = (np.stack(x, axis=2).reshape(TREES, 2 * wide, -1)
                    for x in ((a, above), (below, b)))

    def _leaf(self, t: int, rows: np.ndarray) -> np.ndarray:
        """The node of tree t in which each row ends."""
        index = np.arange(len(rows))
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(DEPTH):
            f = self.feature[t, node]
            inner = f >= 0
            if not inner.any():
                break
            right = rows[index, np.maximum(f, 0)] > self.cut[t, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def ends(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows end in each node, ``[tree, node]``."""
        return np.array([np.bincount(self._leaf(t, rows), minlength=NODES) for t in range(TREES)],
                        dtype=np.int64)

    def counted(self, ends: np.ndarray) -> IsolationForest:
        """The forest with leaves and paths, from :meth:`ends` of all good
        rows."""
        n = ends.copy()
        for node in range(NODES // 2 - 1, -1, -1):
            n[:, node] += n[:, 2 * node + 1] + n[:, 2 * node + 2]
        depth = np.floor(np.log2(np.arange(1, NODES + 1) + 0.5))
        leaf = (self.feature < 0) | (n < 2)
        entered = np.ones_like(leaf)
        for node in range(1, NODES):
            up = (node - 1) // 2
            entered[:, node] = entered[:, up] & ~leaf[:, up]
        self.feature[leaf | ~entered] = -1
        self.path = np.where(leaf & entered, depth + _usual_depth(n), 0.0)
        return self

    def mean_path(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length over the trees (low: unusual)."""
        total = np.zeros(len(rows))
        for t in range(TREES):
            total += self.path[t, self._leaf(t, rows)]
        return total / TREES


def _threshold(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The path length below which rows are rejected, from the good and bad
    rows per step of path lengths (ascending): the end of the step that
    rejects most bad rows net of good ones, with at most ``GOOD_LOSS`` of the
    good."""
    lost = np.cumsum(good) / good.sum()
    caught = np.cumsum(bad) / bad.sum()
    gain = np.where(lost <= GOOD_LOSS, caught - lost, -1.0)
    best = int(np.argmax(gain))
    return -np.inf if gain[best] <= 0 else float((steps[best] + 1) * STEP)


def fit_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              label: str = "quality"):
    """``(forest, threshold)`` from all labelled rows (label 1: good) that pass
    the fixed rules. An id is learnt from once: of its texts the one with the
    smallest hash, of its labels the smallest. Without such rows of both kinds
    nothing is rejected but by the fixed rules: (None, -inf).

    The statistics of the labelled rows are written once; the driver takes
    their range, the counts per node and the counts per step of path lengths,
    none of which grows with the rows. Statistics, not texts, meet the
    labels, which may be too many to broadcast."""
    known = known_labels(labels, label, doc_id)
    stats = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"),
        _statistics()(F.col(text)).alias("_s"))
    one = (stats.join(known, "doc_id").groupBy("doc_id")
           .agg(F.min("label").alias("label"), F.min_by("_s", "h").alias("s")))
    rows = written(one.where(~_fails(F.col("s.n_words"), F.col("s.n_repeat_words"))).select(
        (F.col("label") == 1).alias("good"), F.col("s.ratios").alias("ratios")), "rules-labelled")
    try:
        at = [F.col("ratios")[RATIOS.index(r)] for r in RULES]
        found = rows.agg(F.count_if("good"), F.count_if(~F.col("good")),
                         *[F.min(c) for c in at], *[F.max(c) for c in at]).first()
        if not found[0] or not found[1]:
            return None, -np.inf
        low, high = (np.sqrt(np.array(x, dtype=np.float64))
                     for x in (found[2:2 + len(at)], found[2 + len(at):]))
        forest = IsolationForest.drawn(low, high)
        ends = np.zeros((TREES, NODES), dtype=np.int64)
        n = _node_counts(rows.where("good"), forest).toPandas()
        ends[n["tree"], n["node"]] = n["n"]
        forest.counted(ends)
        steps = (_path_steps(rows, forest).groupBy("step")
                 .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
                 .orderBy("step").toPandas())
        return forest, _threshold(*(steps[c].to_numpy() for c in ("step", "good", "bad")))
    finally:
        dropped(rows)


def _values_of(batch: pa.RecordBatch) -> np.ndarray:
    ratios = batch.column("ratios")
    return _rule_values(ratios.flatten().to_numpy(zero_copy_only=False).reshape(len(ratios), -1))


def _node_counts(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """``(tree, node, n)``: how many of the rows end in each node."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TREES, NODES), dtype=np.int64)
        for batch in batches:
            total += shared.value.ends(_values_of(batch))
        tree, node = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)),
             pa.array(total[tree, node])], names=["tree", "node", "n"])

    return (rows.select("ratios").mapInArrow(counted, "tree int, node int, n bigint")
            .groupBy("tree", "node").agg(F.sum("n").alias("n")))


def _path_steps(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """``(good, step)``: in which step of path lengths each row lies."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor(shared.value.mean_path(_values_of(batch)) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(step)],
                                             names=["good", "step"])

    return rows.mapInArrow(walked, "good boolean, step bigint")


def _fails(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _statistics():
    fields = ",".join(f"{c}:bigint" for c in COUNTS)

    @F.arrow_udf(f"struct<{fields},ratios:array<double>>")
    def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("statistics"):
            for batch in batches:
                counts, ratios = document_statistics(batch)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(ratios.ravel()), len(RATIOS))
                yield pa.StructArray.from_arrays(
                    [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                    + [flat.cast(pa.list_(pa.float64()))], names=[*COUNTS, "ratios"])

    return statistics.asNondeterministic()


def judge(df: DataFrame, model, text: str = "text") -> Column:
    """A struct column: the counts, ``path`` (mean path length; null without
    a forest), ``base_failed`` and ``kept`` of each whole text."""
    forest, threshold = model
    fields = ",".join(f"{c}:bigint" for c in COUNTS)
    shared = df.sparkSession.sparkContext.broadcast((forest, threshold))

    @F.arrow_udf(f"struct<{fields},path:double,base_failed:boolean,kept:boolean>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("statistics"):
            trees, cut = shared.value
            for batch in batches:
                counts, ratios = document_statistics(batch)
                failed = _fails(counts[:, 0], counts[:, COUNTS.index("n_repeat_words")])
                path = (np.full(len(counts), np.nan) if trees is None
                        else trees.mean_path(_rule_values(ratios)))
                usual = np.ones(len(counts), bool) if trees is None else path >= cut
                yield pa.StructArray.from_arrays(
                    [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                    + [pa.array(path, from_pandas=True), pa.array(failed), pa.array(usual & ~failed)],
                    names=[*COUNTS, "path", "base_failed", "kept"])

    return judged.asNondeterministic()(F.col(text))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality") -> DataFrame:
    """Counts and verdict of every row: ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, path``.

    Null, empty and blank texts have no words and fail the fixed rules.
    Repeated rows are judged alike; other columns are not read; an empty table
    gives an empty result. One scan after the fit, no shuffle."""
    model = fit_rules(docs, labels, doc_id, text, label)
    out = docs.select(F.col(doc_id).alias("doc_id"), judge(docs, model, text).alias("_j"))
    return out.select("doc_id", *[F.col(f"_j.{c}") for c in
                                  (*COUNTS, "base_failed", "kept", "path")])
