"""The quality rules are fitted on all labelled rows."""

import random
import zlib

import numpy as np

from tidepool.llm import quality_rules
from tidepool.llm.statistics import document_statistics


def _text(rng, bad):
    words = [rng.choice("tide pool reef kelp crab shell wave salt sand rock".split())
             + str(rng.randrange(10**6)) for _ in range(60)]
    return " ".join(w + "!###" if bad else w + "!" * rng.randrange(2) for w in words)


def test_every_labelled_row_counts(spark):
    """900 good rows, more than a tree took before (512), counted by Spark over
    several tasks as a plain fit counts them; the threshold as a plain search
    over all path lengths finds it."""
    rng = random.Random(5)
    rows = [(i, _text(rng, i % 10 == 0), int(i % 10 != 0)) for i in range(1250)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    forest, cut = quality_rules.fit_rules(docs, labels)
    values = quality_rules._rule_values(document_statistics([t for _, t, _ in rows])[1])
    good = np.array([q == 1 for _, _, q in rows])
    assert good.sum() > 800
    plain = quality_rules.IsolationForest(values[good], values.min(axis=0), values.max(axis=0))
    assert (plain.feature == forest.feature).all() and (plain.path == forest.path).all()
    path = plain.mean_path(values)
    edges = (np.unique(np.floor(path / quality_rules.STEP)) + 1) * quality_rules.STEP

    def gain(e):
        lost = (path[good] < e).mean()
        return (path[~good] < e).mean() - lost if lost <= quality_rules.GOOD_LOSS else -1

    assert cut == max(edges, key=gain) and gain(cut) > 0.5


def test_counts_add_up_over_parts():
    rng = np.random.default_rng(3)
    rows = rng.random((300, 7))
    forest = quality_rules.IsolationForest.drawn(rows.min(axis=0), rows.max(axis=0))
    ends = forest.ends(rows)
    assert (ends.sum(axis=1) == 300).all()
    assert (forest.ends(rows[:100]) + forest.ends(rows[100:]) == ends).all()
