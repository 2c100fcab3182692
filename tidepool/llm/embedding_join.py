"""Near duplicates of embeddings by an epsilon grid order join.

Unit vectors are projected on a few principal axes and sorted by the cells of
a grid of side eps (the distance that the cosine bound allows). The sorted
sequence is cut into blocks with bounding boxes; pairs of blocks whose boxes
are farther apart than eps are never joined, and inside a joined pair the two
intervals are halved recursively, skipping what is provably distant, down to
small matrix products. Projections never lengthen distances, so no pair is
lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import (BROADCAST_BYTES, Forest, dropped, labelled_components, small,
                                 written)

# Principal axes of the grid, and the vectors (documented bound) they are fitted on.
AXES, FIT_VECTORS = 4, 4_000
# Vectors of a block, and of an interval that is not halved any further.
BLOCK_ROWS, LEAF_ROWS = 2_048, 256
BLOCK_BYTES = 8 << 20
# Blocks of a tile at most: two tiles are held by a task.
TILE_BLOCKS = 8


def _matrix(vectors: pa.Array) -> np.ndarray | None:
    """Rows of equal length without nulls as doubles, else None."""
    if len(vectors) == 0 or vectors.null_count:
        return None
    values = vectors.flatten()
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if values.null_count or size.min() != size.max() or size[0] == 0:
        return None
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def vector_digest(embedding: str = "embedding") -> Column:
    """128 bits of a usable vector's values (equal vectors alike), null for
    a vector that is null, empty, zero or holds null or non-finite values."""
    @F.arrow_udf("binary")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        def of(row: np.ndarray):
            usable = len(row) and np.isfinite(row).all() and row.any()
            return xxhash.xxh3_128_digest((row + 0.0).tobytes()) if usable else None

        for batch in batches:
            rows = _matrix(batch)
            if rows is None:
                rows = [np.zeros(0) if v is None or any(x is None for x in v)
                        else np.array(v, dtype=np.float64) for v in batch.to_pylist()]
            yield pa.array([of(r) for r in rows], type=pa.binary())

    return digest.asNondeterministic()(F.col(embedding).cast("array<double>"))


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _fit_axes(classes: DataFrame, n: int) -> np.ndarray:
    """The leading principal axes of the most frequent dimension, from a
    bounded hash-chosen sample. Any axes give the same links; good ones skip
    more."""
    top = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return np.zeros((0, AXES))
    scale = 1 << 40
    share = min(scale, scale * FIT_VECTORS // max(1, n))
    rows = classes.where((F.col("dim") == top["dim"]) & (
        F.pmod(F.xxhash64("digest"), F.lit(scale)) < F.lit(share))).select("vector").toArrow()
    sample = _matrix(rows["vector"].combine_chunks()) if rows.num_rows else None
    if sample is None:
        return np.eye(top["dim"], min(AXES, top["dim"]))
    unit = _unit(sample)
    centred = unit - unit.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1][:, :AXES])


def _projected(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Add ``place`` (coordinates on the axes) and ``cells`` to every class."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    @F.arrow_udf("array<double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = shared.value
        for batch in batches:
            rows = _matrix(batch)
            if rows is not None and rows.shape[1] == len(p):
                at = (_unit(rows) @ p).tolist()
            else:
                at = [(_unit(np.array([v], dtype=np.float64)) @ p)[0].tolist()
                      if len(v) == len(p) else [0.0] * p.shape[1] for v in batch.to_pylist()]
            yield pa.array(at, type=pa.list_(pa.float64()))

    at = place.asNondeterministic()(F.col("vector").cast("array<double>"))
    return classes.withColumn("place", at).withColumn(
        "cells", F.transform("place", lambda x: F.floor(x / F.lit(eps))))


BLOCK = ("block bigint, label string, dim int, low array<double>, high array<double>, n int,"
         " classes binary, weights binary, places binary, vectors binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted in grid order to one row per block of one label and dimension."""
    first = TaskContext.get().partitionId() << 32
    made = 0
    pending: list[tuple] = []
    group = None

    def closed() -> pa.RecordBatch:
        nonlocal made, pending
        classes, weights, places, vectors = zip(*pending)
        places, vectors = np.array(places), np.array(vectors, dtype=np.float64)
        row = {"block": first + made, "label": group[0], "dim": group[1],
               "low": places.min(axis=0).tolist(), "high": places.max(axis=0).tolist(),
               "n": len(classes), "classes": np.array(classes, dtype=np.int64).tobytes(),
               "weights": np.array(weights, dtype=np.int64).tobytes(),
               "places": places.tobytes(), "vectors": _unit(vectors).tobytes()}
        made, pending = made + 1, []
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()),
            ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("n", pa.int32()),
            ("classes", pa.binary()), ("weights", pa.binary()), ("places", pa.binary()),
            ("vectors", pa.binary())]))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in
                   ("label", "dim", "class", "weight", "place", "vector")]
        for label, dim, own, weight, place, vector in zip(*columns):
            limit = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dim)))
            if pending and (group != (label, dim) or len(pending) >= limit):
                yield closed()
            group = (label, dim)
            pending.append((own, weight, place, vector))
    if pending:
        yield closed()


class _Joined:
    """Links between (or within) two blocks: weighted link counts per vector
    and a forest that connects what is linked."""

    def __init__(self, a: dict, b: dict | None, bound: float, eps: float):
        sides = [a] if b is None else [a, b]
        self.bound, self.eps2 = bound, eps * eps
        self.classes = np.concatenate([np.frombuffer(s["classes"], np.int64) for s in sides])
        self.weights = np.concatenate([np.frombuffer(s["weights"], np.int64) for s in sides])
        self.places = np.concatenate([np.frombuffer(s["places"], np.float64)
                                      .reshape(s["n"], -1) for s in sides])
        self.vectors = np.concatenate([np.frombuffer(s["vectors"], np.float64)
                                       .reshape(s["n"], -1) for s in sides])
        self.count = np.zeros(len(self.classes), dtype=np.int64)
        self.forest = Forest(len(self.classes))
        if b is None:
            self.inside(0, a["n"])
        else:
            self.between(0, a["n"], a["n"], a["n"] + b["n"])

    def inside(self, lo: int, hi: int) -> None:
        if hi - lo <= LEAF_ROWS:
            self.product(lo, hi, lo, hi)
            return
        mid = (lo + hi) // 2
        self.inside(lo, mid)
        self.inside(mid, hi)
        self.between(lo, mid, mid, hi)

    def between(self, alo: int, ahi: int, blo: int, bhi: int) -> None:
        a, b = self.places[alo:ahi], self.places[blo:bhi]
        gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0),
                                       b.min(axis=0) - a.max(axis=0)))
        if (gap * gap).sum() > self.eps2:
            return
        if max(ahi - alo, bhi - blo) <= LEAF_ROWS:
            self.product(alo, ahi, blo, bhi)
        elif ahi - alo >= bhi - blo:
            mid = (alo + ahi) // 2
            self.between(alo, mid, blo, bhi)
            self.between(mid, ahi, blo, bhi)
        else:
            mid = (blo + bhi) // 2
            self.between(alo, ahi, blo, mid)
            self.between(alo, ahi, mid, bhi)

    def product(self, alo: int, ahi: int, blo: int, bhi: int) -> None:
        linked = self.vectors[alo:ahi] @ self.vectors[blo:bhi].T >= self.bound
        if alo == blo:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.count[alo:ahi] += linked @ self.weights[blo:bhi]
        if alo != blo:
            self.count[blo:bhi] += self.weights[alo:ahi] @ linked
        self.forest.join(np.arange(alo, ahi), np.arange(blo, bhi), linked)

    def rows(self) -> pa.Table:
        hit = np.flatnonzero(self.count)
        tree, root = self.forest.edges()
        return pa.table({
            "a": pa.array(np.concatenate([self.classes[hit], self.classes[tree]])),
            "b": pa.array(np.concatenate([self.classes[hit], self.classes[root]])),
            "links": pa.array(np.concatenate([self.count[hit], np.zeros(len(tree), np.int64)]))})


def _block_pairs(summary: DataFrame, eps: float) -> DataFrame:
    """``(a, b)``, a <= b: pairs of blocks of one label and dimension whose
    boxes are at most eps apart. Blocks meet in the cells of the first axis
    (a block's own cells against the other's and their neighbours')."""
    cell = lambda c: F.floor(c / F.lit(eps)).cast("bigint")
    left = summary.select("label", "dim", F.col("block").alias("a"), F.col("low").alias("la"),
                          F.col("high").alias("ha"),
                          F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0])))
                          .alias("cell"))
    right = summary.select("label", "dim", F.col("block").alias("b"), F.col("low").alias("lb"),
                           F.col("high").alias("hb"),
                           F.explode(F.sequence(cell(F.col("low")[0]) - 1,
                                                cell(F.col("high")[0]) + 1)).alias("cell"))
    gaps = F.transform(F.arrays_zip("la", "ha", "lb", "hb"), lambda x: F.greatest(
        F.lit(0.0), x["la"] - x["hb"], x["lb"] - x["ha"]))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= F.lit(eps * eps)
    return (left.join(right, ["label", "dim", "cell"]).where(F.col("a") <= F.col("b"))
            .where(near).select("a", "b").distinct())


def _dealt(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The blocks once for every pair of tiles ``(ta, tb)`` that has block
    pairs. A tile is a stretch of blocks of one label and dimension, about as
    many as the square root of a block's partners, so that a block is sent to
    about that many tasks, not to one per partner."""
    n_pairs, n_blocks = pairs.count(), blocks.count()
    width = max(1, min(TILE_BLOCKS, math.isqrt(n_pairs // max(1, n_blocks))))
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1
    tiles = written(blocks.select("label", "dim", "block").select(
        "block", F.min("block").over(Window.partitionBy(
            "label", "dim", F.floor(place / width))).alias("tile")), "block-tiles")
    ta, tb = (small(tiles.select(F.col("block").alias(c), F.col("tile").alias(f"t{c}")), 16,
                    n_blocks) for c in "ab")
    met = written(pairs.join(ta, "a").join(tb, "b").select("ta", "tb").distinct(), "tile-pairs")
    ends = met.select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
    sent = tiles.join(small(ends, 32, 2 * met.count()), "tile")
    return blocks.drop("label", "dim", "low", "high").join(
        small(sent, 48, sent.count()), "block")


def embedding_near_duplicates(df: DataFrame, bound: float = 0.93, vec_id: str = "vec_id",
                              embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``df``.

    Vectors of equal, non-null label (and dimension) link when their cosine,
    in double precision, is ``bound`` or more. ``n_links`` counts the other
    rows linked directly; ``component_id`` is the smallest id reachable;
    ``kept`` is true for that row. A row whose vector is unusable (see
    :func:`vector_digest`) or whose label or id is null links with nothing:
    no links, its own component, kept. Equal vectors are one class with a
    weight, so large groups of copies cost one vector; other large groups
    give counts and a forest, never all their pairs. Other columns are not
    read; an empty table gives an empty result."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * bound))) + 1e-6
    usable = F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    rows = written(df.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.when(usable, vector_digest(embedding)).alias("digest"),
        F.col(embedding).alias("vector")), "vectors")
    classes = written(
        rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
            F.first("vector").alias("vector"))
        .withColumns({"dim": F.size("vector"), "class": F.monotonically_increasing_id()}),
        "vector-classes")
    n = classes.count()
    axes = _fit_axes(classes, n)
    order = ["label", "dim", "cells", "class"]
    placed = _projected(classes, axes, eps).drop("digest", "rep")
    blocks = written(
        placed.repartitionByRange(max(1, -(-n // BLOCK_ROWS)), *order)
        .sortWithinPartitions(*order).mapInArrow(_blocks, BLOCK), "vector-blocks")
    pairs = written(_block_pairs(blocks.select("block", "label", "dim", "low", "high"), eps),
                    "block-pairs")
    dealt = _dealt(blocks, pairs)

    def joined(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda s: s["block"])
        ta, tb = sides[0]["ta"], sides[0]["tb"]
        # blocks of a pair of tiles that lie too far apart give no rows
        return pa.concat_tables([
            _Joined(a, None if a is b else b, bound, eps).rows()
            for a in sides if a["tile"] == ta for b in sides
            if b["tile"] == tb and a["block"] <= b["block"]])

    found = written(dealt.groupBy("ta", "tb").applyInArrow(joined, "a bigint, b bigint, links bigint"),
                    "vector-links")
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    component = labelled_components(found.where("a <> b").select("a", "b"), "vector-components")
    of_class = written(
        classes.select("label", "digest", "rep", "weight", "class").join(counts, "class", "left")
        .join(component.withColumnRenamed("node", "class"), "class", "left")
        .select("label", "digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
                .alias("n_links"), F.coalesce("component", "class").alias("component")),
        "vector-results")
    smallest = written(of_class.groupBy(F.col("component").alias("_component")).agg(
        F.min("rep").alias("component_id")), "vector-smallest")
    dropped(classes, blocks, pairs, found, component)
    named = of_class.join(small(smallest, 16, n), F.col("component") == F.col("_component")) \
        .select("label", "digest", "n_links", "component_id")
    out = rows.select("vec_id", "label", "digest").join(
        F.broadcast(named) if n * 64 <= BROADCAST_BYTES else named, ["label", "digest"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
