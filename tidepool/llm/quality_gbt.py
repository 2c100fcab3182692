"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are binned at quantiles, trees grow level by level from histograms
of gradients, and the fitted trees are flattened into arrays that numpy walks
for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import lean_task
from tidepool.llm.labels import held_out, labelled_sample
from tidepool.llm.statistics import RATIOS, document_statistics

# Documented bound: at most about this many labelled rows are collected to fit.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_ROWS = 150, 5, 64, 0.1, 1.0, 10
PREDICT_FROM = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Complete trees of depth ``DEPTH`` in arrays: inner node k of tree t
    sends a row right (to 2k+2) if its feature is above the cut, else left (to
    2k+1); the last level holds the leaf values. Nodes that were not split
    send every row left."""

    def __init__(self, rows: np.ndarray, label: np.ndarray):
        inner = 2 ** DEPTH - 1
        self.feature = np.zeros((TREES, inner), dtype=np.int32)
        self.cut = np.full((TREES, inner), np.inf)
        self.leaf = np.zeros((TREES, inner + 1))
        mean = (label.sum() + 1.0) / (len(label) + 2.0)
        self.base = float(np.log(mean / (1 - mean)))
        if len(label) < 2 * MIN_ROWS or label.min() == label.max():
            return
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
                 for f in range(rows.shape[1])]
        binned = np.stack([np.searchsorted(e, rows[:, f], side="left")
                           for f, e in enumerate(edges)])
        raw = np.full(len(label), self.base)
        for t in range(TREES):
            p = _sigmoid(raw)
            raw += self._grow(t, binned, edges, p - label, p * (1 - p))

    def _grow(self, t: int, binned, edges, grad, hess) -> np.ndarray:
        node = np.zeros(len(grad), dtype=np.int64)  # within the level
        for level in range(DEPTH):
            width, first = 2 ** level, 2 ** level - 1
            total_g = np.bincount(node, grad, width)
            total_h = np.bincount(node, hess, width)
            best_gain = np.full(width, 1e-6)
            best_f = np.zeros(width, dtype=np.int64)
            best_bin = np.full(width, BINS)
            for f, bins in enumerate(binned):
                if not len(edges[f]):
                    continue
                slot = node * BINS + bins
                shape = (width, BINS)
                g = np.bincount(slot, grad, width * BINS).reshape(shape).cumsum(axis=1)
                h = np.bincount(slot, hess, width * BINS).reshape(shape).cumsum(axis=1)
                n = np.bincount(slot, minlength=width * BINS).reshape(shape).cumsum(axis=1)
                gain = (g ** 2 / (h + RIDGE) + (total_g[:, None] - g) ** 2
                        / (total_h[:, None] - h + RIDGE)
                        - (total_g ** 2 / (total_h + RIDGE))[:, None])
                gain[(n < MIN_ROWS) | (n[:, -1:] - n < MIN_ROWS)] = 0
                gain[:, len(edges[f]):] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best_gain
                best_gain[better], best_f[better], best_bin[better] = top[better], f, at[better]
            split = best_bin < BINS
            self.feature[t, first:first + width][split] = best_f[split]
            self.cut[t, first:first + width][split] = [
                edges[f][b] for f, b in zip(best_f[split], best_bin[split])]
            right = binned[best_f[node], np.arange(len(node))] > best_bin[node]
            node = 2 * node + right
        width = 2 ** DEPTH
        value = -np.bincount(node, grad, width) / (np.bincount(node, hess, width) + RIDGE) * RATE
        self.leaf[t] = value
        return value[node]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every row."""
        raw = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        inner = 2 ** DEPTH - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[index, feature[node]] > cut[node])
            raw += leaf[node - inner]
        return _sigmoid(raw)


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality", max_rows: int = FIT_ROWS) -> BoostedTrees:
    """Trees fitted on the statistics of about ``max_rows`` labelled rows at
    most, chosen by a hash of the id, outside the held-out fold. Only numbers
    of the texts are collected. An id is learnt from once: of its texts the
    one with the smallest hash, of its labels the smallest, so the fit does
    not depend on how rows are dealt. Without labels of both kinds the score
    is the labels' smoothed mean (0.5 without any)."""

    @F.arrow_udf("array<double>")
    def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("statistics"):
            for batch in batches:
                _, ratios = document_statistics(batch)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(ratios.ravel()), len(RATIOS))
                yield flat.cast(pa.list_(pa.float64()))

    sample = labelled_sample(docs, labels, label, max_rows, doc_id, text)
    rows = (sample.select("doc_id", "label", F.xxhash64("text").alias("h"),
                          statistics.asNondeterministic()("text").alias("r"))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("r", "h").alias("r"))
            .orderBy("doc_id").toPandas())
    matrix = np.array(rows["r"].tolist()).reshape(len(rows), len(RATIOS))
    return BoostedTrees(matrix, rows["label"].to_numpy(dtype=np.float64))


def score_texts(df: DataFrame, model: BoostedTrees, text: str = "text") -> Column:
    """A DOUBLE column of ``df``: the score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("statistics"):
            trees = shared.value
            for batch in batches:
                _, ratios = document_statistics(batch)
                yield pa.array(trees.score(ratios))

    return score.asNondeterministic()(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                   text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The inputs of the score are statistics of the text alone. Null and empty
    texts are scored as texts without words. Null ids are never held out.
    Repeated rows score alike; other columns are not read; an empty table
    gives an empty result. One scan after the fit, no shuffle."""
    model = fit_quality(docs, labels, doc_id, text, label)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                      score_texts(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= F.lit(PREDICT_FROM)).cast("int"))
