"""Statistics against brute force; the trained models on held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import ODD_TEXTS, SMALL, documents
from tidepool.llm import quality_gbt, quality_rules
from tidepool.llm.statistics import COUNTS, RATIOS, document_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup,
            len(covered))


def labelled(spark):
    return (spark.read.parquet(f"{SMALL}/documents.parquet"),
            spark.read.parquet(f"{SMALL}/labels.parquet"))


def test_counts_equal_brute_force(spark):
    texts = [*ODD_TEXTS, "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "# | < a&b",
             *[r.text for r in labelled(spark)[0].limit(300).collect()]]
    counts, ratios = document_statistics(texts, max_bytes=5_000)
    assert [tuple(c) for c in counts.tolist()] == [brute_counts(t) for t in texts]
    assert ratios.shape == (len(texts), len(RATIOS)) and np.isfinite(ratios).all()
    assert document_statistics([])[0].shape == (0, len(COUNTS))


def test_scores_on_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    rows = quality_gbt.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    assert (rows.held_out == fold).all()
    assert rows.score.between(0, 1).all()
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    own = rows[fold]
    assert (own.predicted == own.quality).mean() > 0.95
    assert (own[own.quality == 1].predicted == 1).mean() > 0.97


def test_score_reads_the_text_only(spark):
    docs, labels = labelled(spark)
    other = docs.selectExpr("doc_id", "text", "'zz' lang", "'q' source", "0L n_chars",
                            "1.0D score")
    plain = {r.doc_id: r.score for r in quality_gbt.quality_scores(docs, labels).collect()}
    assert {r.doc_id: r.score for r in quality_gbt.quality_scores(other, labels).collect()} == plain


def test_sample_is_bounded_and_skips_the_held_out_fold(spark):
    from tidepool.llm.labels import labelled_sample
    docs, labels = labelled(spark)
    rows = labelled_sample(docs, labels, "quality", 100).collect()
    assert 40 < len(rows) < 160
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_odd_rows_are_scored_and_judged(spark):
    _, labels = labelled(spark)
    docs = documents(spark, ODD_TEXTS, ids=[None, *range(1, len(ODD_TEXTS))],
                     extra=["kept", "score", "_j"])
    scores = quality_gbt.quality_scores(docs, labels).collect()
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(scores) == len(rules) == len(ODD_TEXTS)
    assert not any(r.kept for r in rules.values())  # all too short or repetitive
    assert rules[1].n_words == 0 and rules[1].base_failed
    twins = [r.score for r in scores if r.doc_id in (10, 11)]
    assert twins[0] == twins[1]


def test_without_labels(spark):
    docs, labels = labelled(spark)
    none = labels.where("false")
    some = docs.limit(20)
    assert {r.score for r in quality_gbt.quality_scores(some, none).collect()} == {0.5}
    rows = quality_rules.quality_rules(some, none).collect()
    assert all(r.kept != r.base_failed and r.path is None for r in rows)
    empty = documents(spark, [])
    assert quality_gbt.quality_scores(empty, labels).collect() == []
    assert quality_rules.quality_rules(empty, labels).collect() == []


def test_rules_keep_good_and_reject_bad(spark):
    docs, labels = labelled(spark)
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    judged = rows[~rows.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.1


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = quality_gbt.BoostedTrees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    flat = quality_gbt.BoostedTrees(x[:50], np.ones(50))
    assert np.allclose(flat.score(x), 51 / 52)


def test_forest_paths_are_shorter_for_odd_rows():
    rng = np.random.default_rng(2)
    good = np.abs(rng.normal(0, 0.02, size=(600, 7)))
    forest = quality_rules.IsolationForest(good, np.zeros(7), np.ones(7))
    odd = good[:50].copy()
    odd[:, 3] = 0.9
    assert forest.mean_path(odd).max() < forest.mean_path(good).min()


def walk(trees, t, row, node=0, depth=0):
    """The leaf of a row in tree t, step by step."""
    if depth == quality_gbt.DEPTH:
        return trees.leaf[t, node - (2 ** quality_gbt.DEPTH - 1)]
    right = row[trees.feature[t, node]] > trees.cut[t, node]
    return walk(trees, t, row, 2 * node + 1 + right, depth + 1)


def test_scores_equal_a_plain_walk_of_the_trees():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 4)).round(1)
    trees = quality_gbt.BoostedTrees(rows, (rows[:, 0] + rows[:, 1] ** 2 > 0.5).astype(float))
    got = trees.score(rows[:20])
    for row, score in zip(rows[:20], got):
        raw = trees.base + sum(walk(trees, t, row) for t in range(quality_gbt.TREES))
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-12


def test_first_split_equals_an_exhaustive_search():
    rng = np.random.default_rng(9)
    rows = rng.integers(0, 12, size=(120, 3)).astype(float)
    label = (rows[:, 1] > 6).astype(float)
    label[:9] = 1 - label[:9]
    trees = quality_gbt.BoostedTrees(rows, label)
    p = 1 / (1 + np.exp(-trees.base))
    g, h = p - label, np.full(len(label), p * (1 - p))

    def gain(left):
        if min(left.sum(), (~left).sum()) < quality_gbt.MIN_ROWS:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_gbt.RIDGE)
        return part(left) + part(~left) - part(np.ones(len(g), bool))

    best = max(gain(rows[:, f] <= c) for f in range(3) for c in np.unique(rows[:, f]))
    chosen = gain(rows[:, trees.feature[0, 0]] <= trees.cut[0, 0])
    assert chosen > 0 and abs(chosen - best) < 1e-9


def path(forest, t, row, node=0, depth=0):
    f = forest.feature[t, node]
    if f < 0:
        return forest.path[t, node]
    return path(forest, t, row, 2 * node + 1 + (row[f] > forest.cut[t, node]), depth + 1)


def test_path_lengths_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, 3))
    forest = quality_rules.IsolationForest(rows, rows.min(axis=0), rows.max(axis=0))
    look = np.concatenate([rows[:10], [[9.0, 9.0, 9.0], [-9.0, 0.0, 9.0]]])
    mean = [np.mean([path(forest, t, r) for t in range(quality_rules.TREES)]) for r in look]
    assert np.allclose(forest.mean_path(look), mean)
    # a leaf's path is its depth and the usual depth of the rows that end there
    take = np.random.default_rng(7).permutation(len(rows))[:quality_rules.TREE_ROWS]
    for node in np.flatnonzero(forest.path[0])[:40]:
        inside, at, depth = np.ones(len(take), bool), int(node), 0
        while at:
            up = (at - 1) // 2
            right = rows[take][:, forest.feature[0, up]] > forest.cut[0, up]
            inside &= right if at == 2 * up + 2 else ~right
            at, depth = up, depth + 1
        n = int(inside.sum())
        usual = 0.0 if n < 2 else float(quality_rules._usual_depth(n))
        assert abs(forest.path[0, node] - depth - usual) < 1e-9


def test_verdict_on_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    own = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    assert own[own.quality == 1].kept.mean() > 0.93
    assert own[own.quality == 0].kept.mean() < 0.5


def test_fits_do_not_depend_on_how_repeated_ids_are_dealt(spark):
    docs, labels = labelled(spark)
    first = docs.limit(200)
    other = docs.selectExpr("doc_id - 100 doc_id", "text", "lang", "source", "n_chars").limit(300)
    rows = spark.createDataFrame(first.unionByName(other).collect(), docs.schema)
    cuts, trees = set(), set()
    for n in (1, 3, 8):
        dealt = rows.repartition(n)
        forest, cut = quality_rules.fit_rules(dealt, labels)
        cuts.add((cut, None if forest is None else forest.cut.tobytes()))
        trees.add(quality_gbt.fit_quality(dealt, labels).leaf.tobytes())
    assert len(cuts) == 1 and len(trees) == 1
