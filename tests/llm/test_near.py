"""Near duplicates of texts and vectors, and repeated passages, against
brute force over all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tests.llm.helpers import (ODD_TEXTS, SMOKE, Groups, documents, near_duplicates, prose,
                               without_repeats)
from tidepool.llm import common, embedding_join, ngram_join, suffix_dedup
from tidepool.llm.common import labelled_components

# --- components ------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges += [(-5, 300), (7, 7), (None, 3)]
    rng.shuffle(edges)
    want = Groups()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    got = labelled_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {x: want.root(x) for x in list(want.parent)}
    assert len(got) == len({r.node for r in got})


def test_no_edges(spark):
    assert labelled_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- n-gram Jaccard ----------------------------------------------------------------


def near_texts(seed=0):
    """Copies, near copies by few and many edits, a large group, shared
    passages, short texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.choice([3, 6, 30, 80, 160]), 4000)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 25 + 2))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(w))
    base = prose(rng, 120, 4000)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(prose(rng, 40, 4000) + passage) for _ in range(30)]
    texts += [texts[0]] * 5 + [texts[0].upper()]
    return texts


def grouped(spark, texts, ids=None):
    docs = documents(spark, texts, ids, extra=["digest", "node", "n", "component_id"])
    return ngram_join.near_duplicate_groups(docs).collect()


def check_groups(spark, texts):
    want, sets = near_duplicates(texts)
    got = {r.doc_id: r for r in grouped(spark, texts)}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_groups_equal_brute_force(spark):
    check_groups(spark, near_texts())


def test_groups_with_small_blocks_and_parts(spark, monkeypatch):
    for name, value in (("LONG_COLUMN", 3), ("BLOCK_ROWS", 8), ("OVERLAP", 2), ("SPLIT_ROWS", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    check_groups(spark, near_texts(1))


@pytest.mark.parametrize("sizes", [{}, {"LONG_COLUMN": 3, "BLOCK_ROWS": 8, "OVERLAP": 2,
                                        "SPLIT_ROWS": 4}])
def test_links_are_counted(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_texts(4) + ["", None]
    _, sets = near_duplicates(texts)
    want = [0] * len(texts)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            o = len(x & y)
            if o and 100 * o >= 75 * (len(x) + len(y) - o):
                want[i] += 1
                want[j] += 1
    assert max(want) > 30
    docs = documents(spark, texts, extra=["n_links", "links", "weight"])
    got = {r.doc_id: r.n_links
           for r in ngram_join.near_duplicate_groups(docs, count_links=True).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # equal ids and no ids: every row counts
    twice = documents(spark, texts * 2, [9] * len(texts) + [None] * len(texts))
    rows = ngram_join.near_duplicate_groups(twice, count_links=True).collect()
    assert sorted(r.n_links for r in rows) == sorted(
        2 * w + bool(s) for w, s in zip(want, sets) for _ in range(2))


def test_the_sketch_grows_with_the_ngrams(spark, monkeypatch):
    """A counter for four n-grams, so that n-grams of 20 texts lie above those
    of one however many there are (2^20 counters before, whatever the table)."""
    assert [ngram_join._counters(n) for n in (0, 1 << 22, (1 << 22) + 1, 1 << 24, 1 << 40)] == [
        1 << 20, 1 << 20, 1 << 21, 1 << 22, 1 << 25]
    monkeypatch.setattr(ngram_join, "LEAST_COUNTERS", 1 << 8)
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 8)
    monkeypatch.setattr(ngram_join, "HELD_GRAMS", 3000)
    monkeypatch.setattr(ngram_join, "SPLIT_ROWS", 4)
    rng = random.Random(6)
    shared = [" ".join(prose(rng, 44, 1 << 30)) for _ in range(10)]
    texts = [" ".join(prose(rng, 100, 1 << 30) + [shared[i % 10]]) for i in range(200)]
    sets = [s for _, own in ngram_join.ngram_sets(pa.array(texts + shared), 5) for s in own]
    task, schema = ngram_join._described(5)
    docs = documents(spark, texts).selectExpr("doc_id", "xxhash64(text) text_hash", "text")
    levels, hot, parts = ngram_join._sketch(docs.mapInArrow(task, schema))
    flat = np.concatenate(sets[:200])
    assert len(levels) == 1 << 13 >= len(flat) / 4
    counts = np.bincount((flat % np.uint64(len(levels))).astype(np.int64), minlength=len(levels))
    assert levels.tolist() == (ngram_join._levels(counts, len(flat) / len(levels))).tolist()
    want = np.maximum(0, counts - 4 * (len(flat) // len(levels))) // 4
    assert (hot.tolist(), parts.tolist()) == (np.flatnonzero(want).tolist(), want[want > 0].tolist())
    common = np.concatenate(sets[200:]) % np.uint64(len(levels))
    assert levels[common].min() >= 20 and (levels >= 20).sum() <= len(common) + 5


def test_blocks_hold_few_sets_as_objects(monkeypatch):
    """Sets of an Arrow batch become Python objects a few at a time (a whole
    batch, 40 MB, before)."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1 << 20)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i // 3000 for i in range(5000)]), pa.array([bytes([i % 256]) * 8000
                                                               for i in range(5000)])],
        names=["cluster", "grams"])
    tracemalloc.start()
    blocks = [(group, len(rows)) for group, rows in ngram_join._grouped(iter([batch]), ["cluster"])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for group, n in blocks if group == (0,)) == 3000
    assert sum(n for _, n in blocks) == 5000 and max(n for _, n in blocks) <= 132
    assert peak < 8 << 20


def test_levels_keep_the_order_of_counts():
    for mean in (0.01, 5, 60, 4000):
        counts = np.arange(0, 3_000_000, 7)
        levels = ngram_join._levels(counts, mean).astype(int)
        assert (np.diff(levels) >= 0).all() and levels[0] == 0 and levels[-1] > 200
        # a deviation above the mean is told from the mean
        low, high = ngram_join._levels(np.array([mean, mean + mean ** 0.5 + 1]).astype(int), mean)
        assert high > low


def test_groups_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ngram_join, "LONG_COLUMN", 4)
    check_groups(spark, near_texts(2))


def test_smoke_table(spark):
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()
    want, _ = near_duplicates([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_groups(
        spark.read.parquet(f"{SMOKE}/documents.parquet")).collect()}
    assert got == {r.doc_id: rows[w].doc_id for r, w in zip(rows, want)}


def test_odd_rows(spark):
    check_groups(spark, ODD_TEXTS)
    assert grouped(spark, []) == []
    text = " ".join(prose(random.Random(5), 30, 999))
    rows = grouped(spark, [text, text + " x", text, "other words are here now too", None],
                   ids=[None, 9, 9, None, None])
    assert sorted(str(r.component_id) for r in rows) == ["9", "9", "9", "None", "None"]


def test_one_row_of_every_group_stays(spark):
    texts = near_texts(3)
    want, sets = near_duplicates(texts)
    kept = ngram_join.one_of_each_group(documents(spark, texts, extra=["group_id", "kept"]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for i in range(len(texts)) if want[i] == i)
    # the same rows again: of rows equal in id and text one stays
    twice = documents(spark, texts + ["", ""] + texts, [*range(len(texts)), 900, 900,
                                                        *range(len(texts))])
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(twice).collect()) == sorted(
        [i for i in range(len(texts)) if want[i] == i] + [900, 900])


def test_block_product_is_the_overlap():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
            for _ in range(90)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ngram_join.block_product(sets, 40)
    assert (off == want[:40, 40:]).all()
    own = ngram_join.block_product(sets, 90)
    np.fill_diagonal(own, 0)
    np.fill_diagonal(want, 0)
    assert (own == want).all()


# --- embeddings ----------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()),
                        T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def brute_vectors(rows, bound):
    units = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) and not any(x is None for x in v)
        a = np.array(v, dtype=np.float64) if ok else np.zeros(0)
        ok = ok and np.isfinite(a).all() and a.any()
        units.append(a / np.linalg.norm(a) if ok else None)
    links, groups = {i: 0 for i in range(len(rows))}, Groups()
    for i, a in enumerate(units):
        groups.root(rows[i][0])
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] \
                    and len(a) == len(b) and a @ b >= bound:
                links[i] += 1
                links[j] += 1
                groups.join(rows[i][0], rows[j][0])
    return [(r[0], links[i], groups.root(r[0]), groups.root(r[0]) == r[0])
            for i, r in enumerate(rows)]


def vector_rows(seed, n=160, dim=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=dim)
        if rows and rng.random() < 0.6:
            base = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice(
                [0, 0.05, 0.3])
        rows.append((1000 - i, [float(np.float32(x)) for x in base], int(rng.integers(0, 3))))
    hot = rows[0][1]
    rows += [(2000 + i, hot, 1) for i in range(40)]
    rows += [(3000 + i, [float(np.float32(x + rng.normal() * 0.15)) for x in hot], 1)
             for i in range(60)]
    return rows


ODD_VECTORS = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [None, 1.0], 1),
               (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0], None),
               (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1),
               (12, [1e-30, 0.0], 1), (13, [3e38, 0.0], 1), (14, [-1.0, 0.0], 1)]


def near_vectors(spark, rows, bound=0.93):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS dim", "2 AS block", "3 AS rep")
    out = embedding_join.embedding_near_duplicates(df, bound)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())


@pytest.mark.parametrize("seed", range(2))
def test_vectors_equal_brute_force(spark, seed, monkeypatch):
    rows = vector_rows(seed)
    want = sorted(brute_vectors(rows, 0.93))
    assert near_vectors(spark, rows) == want
    monkeypatch.setattr(embedding_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_join, "LEAF_ROWS", 4)
    assert near_vectors(spark, rows) == want


def test_odd_vectors(spark):
    assert near_vectors(spark, ODD_VECTORS) == sorted(brute_vectors(ODD_VECTORS, 0.93))
    assert near_vectors(spark, []) == []
    out = embedding_join.embedding_near_duplicates(spark.createDataFrame(
        [(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], VECTORS)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out) == [
        ("3", 1, 3, True), ("3", 1, 3, True), ("None", 0, None, True)]


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.01], "a"), (3, [0.0, 1.0], "b"),
            (4, [0.01, 1.0], "b"), (5, [0.02, 1.0], "b"),
            (7, [1.0, 0.0], "c"), (7, [0.0, 1.0], "c"), (8, [0.01, 1.0], "c"), (9, [0.0, 1.0], "c")]
    for n in (1, 4):
        df = spark.createDataFrame(
            rows, "vec_id long, embedding array<float>, label string").repartition(n)
        out = embedding_join.embedding_near_duplicates(df, 0.93).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [
            (1, 1, 1), (1, 3, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 3, 1),
            (7, 0, 7), (7, 2, 7), (8, 2, 7), (9, 2, 7)]
        assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_a_block_goes_to_few_pairs_of_tiles(spark):
    n = 64  # one label whose blocks all lie near each other
    blocks = spark.createDataFrame(
        [(i, "a", 2, [0.0], [1.0], 1, b"", b"", b"", b"") for i in range(n)], embedding_join.BLOCK)
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i, n)],
                                  "a bigint, b bigint")
    sent = embedding_join._dealt(blocks, pairs).collect()
    copies = len(sent) / n
    assert copies < 16  # 64 partners each
    tile = {(r.block): r.tile for r in sent}
    met = {(r.ta, r.tb) for r in sent}
    assert all((tile[i], tile[j]) in met for i in range(n) for j in range(i, n))
    assert all({r.ta, r.tb} & {r.tile} for r in sent)


def test_distant_blocks_are_skipped():
    places = np.array([[0.0], [0.1], [5.0]])
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    block = lambda i: {"n": len(i), "classes": np.array(i, np.int64).tobytes(),
                       "weights": np.ones(len(i), np.int64).tobytes(),
                       "places": places[i].tobytes(), "vectors": vectors[i].tobytes()}
    assert embedding_join._Joined(block([0]), block([1]), 0.9, 0.5).count.tolist() == [1, 1]
    assert embedding_join._Joined(block([0]), block([2]), 0.9, 0.5).count.tolist() == [0, 0]


# --- repeated passages ------------------------------------------------------------------


def passage_texts(seed, length):
    rng = random.Random(seed)
    shared = [prose(rng, length + extra, 5000) for extra in (-1, 0, 1, 7, 30)]
    texts = []
    for _ in range(40):
        words = prose(rng, rng.randrange(0, 30), 5000)
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + prose(rng, rng.randrange(0, 12), 5000)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts + [texts[3], " ".join(["again"] * 4 * length), "x " + " ".join(shared[3])]


def check_repeats(spark, texts, length, gram):
    docs = documents(spark, texts, extra=["n_removed", "ranges", "text_hash", "doc_id_"])
    got = suffix_dedup.remove_repeats(docs, length, gram).collect()
    want = without_repeats(list(enumerate(texts)), length)
    assert len(got) == len(texts)
    for r in got:
        assert [w.decode() for w in (r.text or "").encode().split()] == want[r.doc_id], r.doc_id
        assert r.n_removed == len((texts[r.doc_id] or "").encode().split()) - len(want[r.doc_id])
        if not r.n_removed:
            assert r.text == texts[r.doc_id]


@pytest.mark.parametrize("seed,length,gram", [(0, 10, 4), (1, 10, 10), (2, 10, 1), (3, 50, 24)])
def test_repeats_equal_brute_force(spark, seed, length, gram):
    check_repeats(spark, passage_texts(seed, length), length, gram)


def test_repeats_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    check_repeats(spark, passage_texts(4, 12), 12, 5)


def test_repeats_smoke_table(spark):
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()
    want = without_repeats([(r.doc_id, r.text) for r in rows])
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{SMOKE}/documents.parquet")).collect()
    assert {r.doc_id: [w.decode() for w in (r.text or "").encode().split()] for r in got} == want


def test_odd_texts_stay(spark):
    # the one word that fills a long text repeats its own first run
    texts = [t for t in ODD_TEXTS if t != "word " * 3000]
    got = suffix_dedup.remove_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts))
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []
    long = suffix_dedup.remove_repeats(documents(spark, ["word " * 3000])).first()
    assert long.n_removed == 2999 and long.text == "word "


def test_rows_equal_in_id_and_text_are_one_place(spark):
    text = " ".join(prose(random.Random(8), 60, 5000))
    got = suffix_dedup.remove_repeats(documents(spark, [text, text, text, text],
                                                ids=[4, 4, None, 7])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [
        ("4", 60), ("4", 60), ("7", 60), ("None", 0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours_across_partition_edges(spark, monkeypatch, partitions):
    monkeypatch.setattr(suffix_dedup, "_num_partitions", lambda table, n: partitions)
    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(2), rng.choice([None, 5, 6]), 7,
             rng.randrange(3)) for _ in range(90)]
    rows += [(9, 9, 1, 7, 0)] * 60  # a group of equal rows
    df = spark.createDataFrame(rows, "gram long, content long, doc_id long, text_hash long, "
                                     "first int")
    got = suffix_dedup.sorted_neighbours(df, ["gram", "content"]).collect()
    assert len(got) == len(rows)
    place = lambda r: (r[2] is not None, r[2] or 0, r[3], r[4])
    least = {}
    for r in rows:
        least[r[:2]] = min(least.get(r[:2], place(r)), place(r))
    for r in got:
        assert r["_repeat"] == (place(tuple(r)[:5]) != least[r.gram, r.content])
    starts = sorted((r.gram, r.content) for r in got if r["_start"])
    assert starts == sorted(least)
    assert {r.gram for r in got if r["_differs"]} == {
        g for g, _ in least if len({c for x, c in least if x == g}) > 1}
