"""op11: integer product codes against a plain version, and odd input."""

import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from tidepool.llm.vector_codes import fit_codebooks, vector_codes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def plain(rows, parts, entries, rounds):
    """{(id, place among its rows): (code, error, label error, digest)}."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    books = [[v[p * width:(p + 1) * width] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        own = v[p * width:(p + 1) * width]
        d = [sum((a - b) ** 2 for a, b in zip(own, e)) for e in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [nearest(v, p)[0] for _, v, _ in kept]
            book = []
            for e, old in enumerate(books[p]):
                own = [v[p * width:(p + 1) * width] for (_, v, _), x in zip(kept, of) if x == e]
                book.append([sum(c) // len(own) for c in zip(*own)] if own else old)
            new.append(book)
        books = new
    found = [(i, g, [nearest(v, p) for p in range(parts)]) for i, v, g in kept]
    total = {}
    for _, g, n in found:
        total[g] = total.get(g, 0) + sum(d for _, d in n)
    digest = hashlib.sha256(",".join(
        str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for e, _ in n), sum(d for _, d in n), total[g], digest)
                  for i, g, n in found)


def shown(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)
                  for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes_equal_plain_version(spark, partitions):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) / 16 + rng.choice([0, 0.001]) for _ in range(8)],
             rng.choice([0, 1, None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1) for i in range(10)]  # repeated vectors
    rows += [(5, rows[9][1], 0), (None, rows[3][1], None), (7, None, 1), (8, [None] * 8, 1),
             (9, [float("nan")] * 8, 1), (10, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
    got = vector_codes(df, parts=4, entries=6, rounds=2)
    assert shown(got) == plain(rows, 4, 6, 2)


def test_fewer_rows_than_entries_ties_and_unused_entries(spark):
    rows = [(i, [0.5] * 4, None) for i in range(3)] + [(9, [-0.5] * 4, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = shown(vector_codes(df, parts=2, entries=64))
    assert got == plain(rows, 2, 64, 2)
    assert {c for _, c, *_ in got} == {"0000", "0303"}  # equal entries: the first


def test_empty_and_unusable_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes(empty).collect() == []
    assert vector_codes(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).collect() == []
    assert fit_codebooks(empty) is None


def test_lengths_that_cannot_be_cut_are_errors(spark):
    df = spark.createDataFrame([(1, [1.0] * 5, 1, "x")], SCHEMA)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(df, parts=2)
    df = spark.createDataFrame([(1, [1.0] * 4, 1, "x"), (2, [1.0] * 6, 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="different lengths"):
        vector_codes(df, parts=2).collect()
    df = spark.createDataFrame([(1, [1e30] * 4, 1, "x")], SCHEMA)
    with pytest.raises(ValueError, match="smaller scale"):
        vector_codes(df, parts=2)


def test_codes_decode_to_the_nearest_entries(spark):
    rows = [(i, [i / 4, -i / 4, i / 8, 0.25], 0) for i in range(8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    books = fit_codebooks(df, parts=2, entries=8)
    for r in vector_codes(df, parts=2, entries=8).collect():
        assert r.error == 0 and books.decoded(r.code).tolist() == rows[r.vec_id][1]
