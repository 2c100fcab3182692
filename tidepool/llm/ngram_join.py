"""Near-duplicate groups of texts: an exact Jaccard join on word n-grams.

The documents' n-gram sets are the rows of a sparse incidence matrix; two
documents link when their overlap is large against their sizes. The product
of the matrix with its transpose is computed only where the sizes leave room
for a link:

1. Equal sets are one class. A sketch of how many documents hold each n-gram
   (counted over all of them, folded to one counter for four n-grams, 2^25 at
   most) orders n-grams, rare ones first.
2. Sets that link share some of the first n - ceil(t n) + c n-grams of either
   set in that order, and at least c of them. These prefixes are the columns
   that are multiplied: short columns give pairs, whose shared counts are
   summed and dropped below c.
3. Long columns would give a square of pairs. Their documents are gathered in
   clusters, cut into blocks of bounded size, and blocks are multiplied by
   blocks; a block first joins within itself, and pairs of blocks that are
   already in one group are not multiplied again. What comes out is a spanning
   forest, never all pairs.
4. Pairs are checked on their whole sets; groups are the components of links.

The order only decides which candidates are looked at: the links are exact
(up to equal 64-bit hashes of different n-grams or sets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (Forest, dropped, gram_hashes, hashed_texts,
                                 labelled_components, lean_task, mix64, release_memory, small,
                                 written)

WORDS, PERCENT = 5, 75
# Counters of the n-gram sketch: at least and at most (a byte each), n-grams
# for one of them, and counters of a chunk, in which they are summed.
LEAST_COUNTERS, MOST_COUNTERS, GRAMS_A_COUNTER, CHUNK = 1 << 20, 1 << 25, 4, 1 << 16
# n-grams of a task that are counted at once.
HELD_GRAMS = 4_000_000
# Prefix n-grams two sets must share, if they are that large.
SHARED = 3
# A column of more documents than this is long.
LONG_COLUMN = 15
# Documents and bytes of a block; overlap of neighbouring blocks.
BLOCK_ROWS, BLOCK_BYTES, OVERLAP = 1_024, 6 << 20, 64
# Columns of a dense tile of two blocks (8 MB).
TILE = 1_024
# Rows of one n-gram in a partition, beyond which it is dealt to several.
SPLIT_ROWS = 200_000

LINKS = "a bigint, b bigint"


def ngram_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first, sets of texts[first], ...)``, slice by slice: the sorted
    distinct n-gram hashes of every text - all runs of ``words`` words, the
    whole sequence if there are fewer, none without words."""
    for first, hashes in hashed_texts(texts, lower=True):
        yield first, [np.unique(gram_hashes(h, min(words, len(h)))) if len(h)
                      else np.zeros(0, np.uint64) for h in hashes]


def _digest(grams: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _counter(grams: np.ndarray, counters: int) -> np.ndarray:
    return (grams & np.uint64(counters - 1)).astype(np.int64)


def _size_need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap a set of n members can link with."""
    return -(-percent * n // 100)


# --- 1. classes and the sketch ---------------------------------------------------

def _described(words: int):
    """Rows ``(doc_id, text_hash, n, digest)`` of the texts and, with the
    number of a chunk, the ``n`` counters of it that a task's n-grams fall on:
    their sorted places, as compressed differences."""
    schema = ("doc_id bigint, text_hash bigint, n bigint, digest bigint, chunk int,"
              " places binary")
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()),
                       ("digest", pa.int64()), ("chunk", pa.int32()), ("places", pa.binary())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("ngrams"):
            held, size = [], 0
            for batch in batches:
                for first, sets in ngram_sets(batch.column("text"), words):
                    n = len(sets)
                    flat = np.concatenate(sets)
                    held.append((flat & np.uint64(MOST_COUNTERS - 1)).astype(np.uint32))
                    size += len(flat)
                    if size >= HELD_GRAMS:
                        yield counted(held)
                        held, size = [], 0
                    none = pa.nulls(n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, n),
                         batch.column("text_hash").slice(first, n),
                         pa.array([len(s) for s in sets], pa.int64()),
                         pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                         none.cast(pa.int32()), none.cast(pa.binary())], schema=arrow)
            if size:
                yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        counter = np.concatenate(held)
        counter.sort()
        edges = np.searchsorted(counter, np.arange(0, MOST_COUNTERS + 1, CHUNK))
        chunks = np.flatnonzero(np.diff(edges))
        places = []
        for i in chunks:
            own = (counter[edges[i]:edges[i + 1]] & np.uint32(CHUNK - 1)).astype(np.uint16)
            own[1:] = np.diff(own)
            places.append(pa.compress(own.tobytes(), "zstd", asbytes=True))
        none = pa.nulls(len(chunks), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.array(np.diff(edges)[chunks], pa.int64()), none,
             pa.array(chunks, pa.int32()), pa.array(places, pa.binary())], schema=arrow)

    return described, schema


def _levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """Counts in the order they have, as bytes: exact around the mean (in steps
    of an eighth of its usual deviation, if that is more than 1), by their
    logarithm above."""
    step = max(1, int(mean ** 0.5) // 8)
    x = np.maximum(0, counts - max(0, int(mean - 4 * mean ** 0.5))) // step
    above = 128 + 8 * np.log2(np.maximum(x, 128) / 128)
    return np.where(x < 128, x, np.minimum(above, 255)).astype(np.uint8)


def _summed(mean: float, chunks: int):
    """Rows sorted by ``chunk`` modulo ``chunks`` to one row for each: the
    levels of its counters, and those far above the others with their parts."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(CHUNK, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column("chunk")[k].as_py() % chunks
                if last is not None and chunk != last:
                    yield row(last, total)
                    total[:] = 0
                last = chunk
                places = pa.decompress(batch.column("places")[k].as_buffer(),
                                       2 * batch.column("n")[k].as_py(), "zstd", asbytes=True)
                total += np.bincount(np.cumsum(np.frombuffer(places, np.uint16), dtype=np.int64),
                                     minlength=CHUNK)
        if last is not None:
            yield row(last, total)

    def row(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        parts = np.maximum(0, total - 4 * int(mean)) // SPLIT_ROWS
        hot = np.flatnonzero(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([_levels(total, mean).tobytes()]),
             pa.array([(chunk * CHUNK + hot).tobytes()]), pa.array([parts[hot].tobytes()])],
            names=["chunk", "levels", "hot", "parts"])

    return summed, "chunk int, levels binary, hot binary, parts binary"


def _counters(grams: int) -> int:
    """How many counters a sketch of so many n-grams has."""
    wanted = 1 << max(0, -(-grams // GRAMS_A_COUNTER) - 1).bit_length()
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, wanted))


def _sketch(described: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents per counter, added up over all tasks, as levels (a byte each);
    the counters of very many documents, sorted, and the parts that their
    columns are dealt to."""
    grams = described.where("chunk IS NULL").agg(F.sum("n")).first()[0] or 0
    counters = _counters(grams)
    chunks = counters // CHUNK
    task, schema = _summed(grams / counters, chunks)
    found = (described.where("chunk IS NOT NULL")
             .select((F.col("chunk") % chunks).alias("chunk"), "n", "places")
             .repartition("chunk").sortWithinPartitions("chunk").mapInArrow(task, schema))
    levels = np.zeros(counters, dtype=np.uint8)
    hot, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in found.collect():  # at most 512 chunks of 64 KB
        levels[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(
            row["levels"], np.uint8)
        hot.append(np.frombuffer(row["hot"], np.int64))
        parts.append(np.frombuffer(row["parts"], np.int64))
    hot, parts = np.concatenate(hot), np.concatenate(parts)
    order = np.argsort(hot)
    release_memory()
    return levels, hot[order], parts[order]


# --- 2. prefixes, short columns, hubs of long columns ---------------------------

def _prefixes(words: int, percent: int, shared_sketch):
    """Rows ``(gram, part, node, n)`` of every set's prefix. A column that the
    sketch shows to be far above the others is dealt to parts."""
    schema = "gram bigint, part int, node bigint, n bigint"
    arrow = pa.schema([("gram", pa.int64()), ("part", pa.int32()), ("node", pa.int64()),
                       ("n", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("ngrams"):
            levels, *hot = shared_sketch.value
            seen: set[int] = set()
            for batch in batches:
                for _, sets in ngram_sets(batch.column("text"), words):
                    if (rows := of_sets(sets, levels, *hot, seen)) is not None:
                        yield rows

    def of_sets(sets: list, levels: np.ndarray, hot: np.ndarray, hot_parts: np.ndarray,
                seen: set) -> pa.RecordBatch | None:
        grams, nodes, sizes = [], [], []
        for own in sets:
            n = len(own)
            node = _digest(own) if n else None
            if not n or node in seen:
                continue
            if len(seen) >= 300_000:
                seen.clear()
            seen.add(node)
            need = int(_size_need(np.array(n), percent))
            length = n - need + min(SHARED, need)
            order = np.argsort(levels[_counter(own, len(levels))], kind="stable")[:length]
            grams.append(own[order])
            nodes.append(node)
            sizes.append(n)
        if not grams:
            return None
        flat = np.concatenate(grams)
        length = np.fromiter(map(len, grams), np.int64, len(grams))
        node = np.repeat(np.array(nodes, dtype=np.int64), length)
        part = np.zeros(len(flat), dtype=np.int64)
        if len(hot):
            counter = _counter(flat, len(levels))
            at = np.minimum(np.searchsorted(hot, counter), len(hot) - 1)
            is_hot = hot[at] == counter
            part[is_hot] = 1 + (node[is_hot] & 0x7FFFFFFF) % hot_parts[at[is_hot]]
        return pa.RecordBatch.from_arrays(
            [pa.array(flat.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(node),
             pa.array(np.repeat(np.array(sizes, dtype=np.int64), length))], schema=arrow)

    return prefixes, schema


class _Columns:
    """A pass over columns sorted by (gram, part, n, node)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def short(self, column: np.ndarray, node: np.ndarray, n: np.ndarray) -> None:
        """All pairs of rows of one (short) column whose sizes can link."""
        for d in range(1, LONG_COLUMN):
            i = np.flatnonzero(column[:-d] == column[d:]) if len(column) > d else []
            if not len(i):
                return
            a, b, low, high = node[i], node[i + d], n[i], n[i + d]
            fit = 100 * low >= self.percent * high
            a, b, low = a[fit], b[fit], low[fit]
            if len(a):
                need = np.minimum(SHARED, _size_need(low, self.percent))
                self.pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b), need]))
                self.held += len(a)

    def summed(self) -> pa.RecordBatch | None:
        """The pairs so far, with how many columns they shared."""
        if not self.pairs:
            return None
        a, b, need = np.concatenate(self.pairs, axis=1)
        self.pairs, self.held = [], 0
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays(
            [pa.array(a[first]), pa.array(b[first]), pa.array(count), pa.array(need[first])],
            names=["a", "b", "shared", "need"])


def _columns(percent: int):
    """Sorted prefix rows to pairs ``(a, b, shared, need)`` of short columns
    and, with ``shared`` 0, rows ``(hub, node)`` of long ones. At most a short
    column is carried from batch to batch."""
    def hubs(gram: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(node), dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(mix64(gram.view(np.uint64) + np.uint64(1)).view(np.int64)), pa.array(node),
             zero, zero], names=["a", "b", "shared", "need"])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("ngrams"):
            state = _Columns(percent)
            rest = [np.zeros(0, np.int64)] * 4
            open_long = None  # the long column that goes on in the next batch
            for batch in batches:
                new = [batch.column(c).to_numpy().astype(np.int64) for c in
                       ("gram", "part", "node", "n")]
                gram, part, node, n = (np.concatenate(x) for x in zip(rest, new))
                if len(gram) > 1:  # copies of a set arrive once per task
                    same = (gram[1:] == gram[:-1]) & (part[1:] == part[:-1]) & (node[1:] == node[:-1])
                    gram, part, node, n = (x[np.concatenate([[True], ~same])]
                                           for x in (gram, part, node, n))
                begins = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1])
                                                        | (part[1:] != part[:-1])]))
                size = np.diff(np.append(begins, len(gram)))
                is_long = (size > LONG_COLUMN) | (part[begins] > 0)
                if open_long is not None:
                    is_long[0] |= (gram[0], part[0]) == open_long
                last_long = bool(is_long[-1])
                row_long = np.repeat(is_long, size)
                closed = np.ones(len(gram), dtype=bool)
                if not last_long:  # a short column may go on: keep it back
                    closed[begins[-1]:] = False
                if row_long.any():
                    yield hubs(gram[row_long], node[row_long])
                take = closed & ~row_long
                column = np.repeat(np.arange(len(begins)), size)[take]
                state.short(column, node[take], n[take])
                # of a long column one row stays, to know it and drop its copy
                open_long = (gram[-1], part[-1]) if last_long else None
                back = slice(len(gram) - 1, None) if last_long else slice(begins[-1], None)
                rest = [x[back] for x in (gram, part, node, n)]
                if state.held > 400_000:
                    yield state.summed()
            if len(rest[0]) and open_long is None:
                state.short(np.zeros(len(rest[0]), np.int64), rest[2], rest[3])
            if (left := state.summed()) is not None:
                yield left

    return columns


# --- 3. whole sets, checks and blocks ----------------------------------------------

def _whole_sets(words: int):
    schema = "node bigint, n bigint, grams binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("ngrams"):
            for batch in batches:
                for _, sets in ngram_sets(batch.column("text"), words):
                    sets = [s for s in sets if len(s)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(s) for s in sets], pa.int64()),
                         pa.array([len(s) for s in sets], pa.int64()),
                         pa.array([s.tobytes() for s in sets], pa.binary())],
                        names=["node", "n", "grams"])

    return whole, schema


def overlap(left: Column, right: Column) -> Column:
    """Common members of two sorted sets of hashes."""
    @F.arrow_udf("bigint")
    def common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with lean_task("ngrams"):
            for some, others in batches:
                out = []
                for x, y in zip(some.to_pylist(), others.to_pylist()):
                    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    both.sort(kind="stable")
                    out.append(int((both[1:] == both[:-1]).sum()))
                yield pa.array(out, pa.int64())

    return common.asNondeterministic()(left, right)


def block_product(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Overlaps of the first ``split`` sets with the others (with themselves,
    if there are no others): the product of two blocks of the incidence
    matrix. Columns of few documents add pair by pair; columns of many are
    multiplied as dense tiles."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    alone = split == len(sets)
    left = split
    right = split if alone else len(sets) - split
    base = 0 if alone else split
    order = np.lexsort((rows, column))
    rows, column = rows[order], column[order]
    out = np.zeros(left * right, dtype=np.float32)
    light = (count[column] > 1) & (count[column] <= 32)
    r, c = rows[light], column[light]
    for d in range(1, 32):
        i = np.flatnonzero(c[:-d] == c[d:]) if len(c) > d else []
        if not len(i):
            break
        x, y = r[i], r[i + d]  # x < y
        if alone:
            out += np.bincount(x * right + y, minlength=len(out)).astype(np.float32)
        else:
            cross = (x < split) & (y >= split)
            out += np.bincount(x[cross] * right + y[cross] - base,
                               minlength=len(out)).astype(np.float32)
    out = out.reshape(left, right)
    if alone:
        out += out.T
    heavy = count[column] > 32
    r, c = rows[heavy], np.unique(column[heavy], return_inverse=True)[1]
    for lo in range(0, int(c.max()) + 1 if len(c) else 0, TILE):
        a, b = np.searchsorted(c, [lo, lo + TILE])
        tile = np.zeros((len(sets), min(TILE, int(c.max()) + 1 - lo)), dtype=np.float32)
        tile[r[a:b], c[a:b] - lo] = 1
        out += tile[:left] @ tile[base:].T
    return out


def _linked(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    n = np.array([len(s) for s in sets], dtype=np.float64)
    over = block_product(sets, split).astype(np.float64)
    left, right = n[:split], n if split == len(sets) else n[split:]
    linked = 100 * over >= percent * (left[:, None] + right[None, :] - over)
    if split == len(sets):
        np.fill_diagonal(linked, False)
    return linked


def _grouped(batches: Iterator[pa.RecordBatch], group_columns: list[str]) -> Iterator[tuple]:
    """Consecutive rows of equal group columns, cut into blocks of bounded
    rows and bytes: ``(group, rows)``."""
    pending: list[dict] = []
    size, group = 0, None
    for batch in batches:
        # a batch has up to ten thousand sets: few of them are Python objects
        for row in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
            own = tuple(row[c] for c in group_columns)
            if pending and (own != group or len(pending) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                yield group, pending
                pending, size = [], 0
            group = own
            pending.append(row)
            size += len(row["grams"])
    if pending:
        yield group, pending


def _within_blocks(percent: int):
    """Links inside blocks of a cluster, and with the last rows of the block
    before, as a forest."""
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("ngrams"):
            before: list[dict] = []
            last = None
            for group, rows in _grouped(batches, ["cluster"]):
                if group == last:
                    rows = before + rows
                sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
                node = np.array([r["node"] for r in rows], dtype=np.int64)
                forest = Forest(len(rows))
                every = np.arange(len(rows))
                forest.join(every, every, _linked(sets, len(sets), percent))
                member, root = forest.edges()
                yield pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[root])],
                                                 names=["a", "b"])
                before, last = rows[-OVERLAP:], group

    return within


BLOCKS = ("block bigint, cluster bigint, label bigint, low bigint, high bigint,"
          " nodes binary, sizes binary, grams binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cluster and group label to one row per block; ``label``
    is the group that all its documents are in, or null."""
    from pyspark import TaskContext
    first = TaskContext.get().partitionId() << 32
    for k, (group, rows) in enumerate(_grouped(batches, ["cluster"])):
        labels = {r["label"] for r in rows}
        n = np.array([r["n"] for r in rows], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + k]), pa.array([group[0]], pa.int64()),
             pa.array([labels.pop() if len(labels) == 1 else None], pa.int64()),
             pa.array([int(n.min())]), pa.array([int(n.max())]),
             pa.array([np.array([r["node"] for r in rows], dtype=np.int64).tobytes()]),
             pa.array([n.tobytes()]), pa.array([b"".join(r["grams"] for r in rows)])],
            names=["block", "cluster", "label", "low", "high", "nodes", "sizes", "grams"])


def _split_sets(block: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    n = np.frombuffer(block["sizes"], np.int64)
    grams = np.frombuffer(block["grams"], np.uint64)
    return np.frombuffer(block["nodes"], np.int64), np.split(grams, np.cumsum(n)[:-1])


def _block_pairs(blocks: DataFrame, majors: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: blocks of one cluster that may hold links between groups.
    Blocks wholly in their cluster's largest group need not meet each other,
    so they are only on one side; sizes must leave room for a link."""
    seen = blocks.join(majors, "cluster", "left").select(
        "cluster", "block", "label", "low", "high",
        F.coalesce(F.col("label") == F.col("major"), F.lit(False)).alias("major"))
    seen = written(seen, "ngram-block-list")
    left = seen.where("NOT major").select("cluster", *[F.col(c).alias(f"{c}_a") for c in
                                                       ("block", "label", "low", "high")])
    right = seen.select("cluster", F.col("major").alias("major_b"),
                        *[F.col(c).alias(f"{c}_b") for c in ("block", "label", "low", "high")])
    once = F.col("major_b") | (F.col("block_a") <= F.col("block_b"))
    room = ((100 * F.col("high_b") >= percent * F.col("low_a"))
            & (100 * F.col("high_a") >= percent * F.col("low_b")))
    apart = ~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))
    return left.join(right, "cluster").where(once & room & apart).select(
        F.col("block_a").alias("a"), F.col("block_b").alias("b"))


def _between_blocks(percent: int):
    def between(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda s: s["block"])
        nodes, sets = _split_sets(sides[0])
        split = len(sets)
        if len(sides) > 1:
            other, more = _split_sets(sides[1])
            nodes, sets = np.concatenate([nodes, other]), sets + more
        linked = _linked(sets, split, percent)
        forest = Forest(len(nodes))
        every = np.arange(len(nodes))
        forest.join(every[:split], every[split:] if len(sides) > 1 else every, linked)
        member, root = forest.edges()
        return pa.table({"a": nodes[member], "b": nodes[root]})

    return between


def _cluster_links(members: DataFrame, known: DataFrame, percent: int) -> tuple:
    """Links among the members ``(cluster, node, n, grams)`` of clusters, as
    two tables of forests: first within blocks by size, then between blocks by the groups
    these links (and the ``known`` ones) give."""
    n = members.count()
    parts = max(1, -(-n // BLOCK_ROWS))
    order = ["cluster", "n", "node"]
    first = written(members.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .mapInArrow(_within_blocks(percent), LINKS), "ngram-block-links")
    label = labelled_components(first.union(known), "ngram-groups")
    named = members.join(small(label, 24), "node", "left")
    named = named.withColumn("label", F.coalesce("component", "node")).drop("component")
    order = ["cluster", "label", "n", "node"]
    blocks = written(named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .mapInArrow(_blocks, BLOCKS), "ngram-blocks")
    sizes = named.groupBy("cluster", "label").count()
    majors = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label"))
                                          .alias("major"))
    pairs = written(_block_pairs(blocks.select("cluster", "block", "label", "low", "high"),
                                 majors, percent), "ngram-block-pairs")
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = blocks.select("block", "nodes", "sizes", "grams").join(
        small(ends, 64, 2 * pairs.count()), "block")
    second = written(dealt.groupBy("a", "b").applyInArrow(_between_blocks(percent), LINKS),
                     "ngram-far-links")
    dropped(label, blocks, pairs)
    return first, second


# --- 4. numbers of links ----------------------------------------------------------------

WEIGHTED_BLOCKS = ("block bigint, cluster bigint, low bigint, high bigint,"
                   " nodes binary, sizes binary, weights binary, grams binary")


def _weighted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cluster and size to one row per block."""
    from pyspark import TaskContext
    first = TaskContext.get().partitionId() << 32
    for k, (group, rows) in enumerate(_grouped(batches, ["cluster"])):
        node, n, weight = (np.array([r[c] for r in rows], dtype=np.int64)
                           for c in ("node", "n", "weight"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + k]), pa.array([group[0]], pa.int64()),
             pa.array([int(n.min())]), pa.array([int(n.max())]), pa.array([node.tobytes()]),
             pa.array([n.tobytes()]), pa.array([weight.tobytes()]),
             pa.array([b"".join(r["grams"] for r in rows)])],
            names=["block", "cluster", "low", "high", "nodes", "sizes", "weights", "grams"])


def _block_sums(percent: int):
    """The weights of what every document of two blocks (of one, if they are
    the same) links with."""
    def sums(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda s: s["block"])
        nodes, sets = _split_sets(sides[0])
        weight = [np.frombuffer(s["weights"], np.int64) for s in sides]
        split = len(sets)
        if len(sides) > 1:
            other, more = _split_sets(sides[1])
            nodes, sets = np.concatenate([nodes, other]), sets + more
        linked = _linked(sets, split, percent)
        links = linked @ weight[-1]
        if len(sides) > 1:
            links = np.concatenate([links, linked.T @ weight[0]])
        some = links > 0
        return pa.table({"node": nodes[some], "links": links[some]})

    return sums


def _link_counts(members: DataFrame, links: DataFrame, weights: DataFrame,
                 percent: int) -> DataFrame:
    """``(node, links)``: the rows of other classes that the rows of a class
    link with; classes without any are left out. ``links`` are those between
    documents not in one cluster; those among the members of clusters are
    summed from products of all pairs of blocks whose sizes leave room."""
    n = members.count()
    parts = max(1, -(-n // BLOCK_ROWS))
    order = ["cluster", "n", "node"]
    blocks = written(members.join(weights, "node").repartitionByRange(parts, *order)
                     .sortWithinPartitions(*order)
                     .mapInArrow(_weighted_blocks, WEIGHTED_BLOCKS), "ngram-weighted-blocks")
    ranges = blocks.select("cluster", "block", "low", "high")
    left, right = (ranges.select("cluster", *[F.col(c).alias(f"{c}_{side}") for c in
                                              ("block", "low", "high")]) for side in "ab")
    room = ((100 * F.col("high_b") >= percent * F.col("low_a"))
            & (100 * F.col("high_a") >= percent * F.col("low_b")))
    pairs = written(left.join(right, "cluster").where((F.col("block_a") <= F.col("block_b")) & room)
                    .select(F.col("block_a").alias("a"), F.col("block_b").alias("b")),
                    "ngram-weighted-pairs")
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = blocks.select("block", "nodes", "sizes", "weights", "grams").join(
        small(ends, 64, 2 * pairs.count()), "block")
    inside = dealt.groupBy("a", "b").applyInArrow(_block_sums(percent), "node bigint, links bigint")
    once = links.select("a", "b").distinct()
    both = once.union(once.select("b", "a")).toDF("node", "other")
    outside = both.join(weights.toDF("other", "links"), "other").select("node", "links")
    counts = written(inside.union(outside).groupBy("node").agg(F.sum("links").alias("links")),
                     "ngram-link-counts")
    dropped(blocks, pairs)
    return counts


# --- all together --------------------------------------------------------------------

def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS,
                          doc_id: str = "doc_id", text: str = "text",
                          count_links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, group_id, text_hash``, one row per
    row of ``docs``; with ``count_links`` also ``n_links``.

    ``n_shingles`` is the size of the text's set of ``words``-word n-grams
    (words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer words are
    one n-gram; null, empty and blank texts have none and link with nothing).
    Texts link when 100 * overlap >= ``percent`` * union; ``component_id`` is
    the smallest id reachable (ids may repeat; null where all reachable ids
    are null). ``group_id`` names the component (null without words) and
    ``text_hash`` is the xxhash64 of the text. ``n_links`` is the number of
    other rows linked directly, copies with it (0 without words); no pair is
    written for it, but the products take time with the square of a cluster.
    Texts are read whole; other columns are not read; an empty table gives an
    empty result."""
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    task, schema = _described(words)
    described = written(read.mapInArrow(task, schema), "ngram-documents")
    rows = described.where("chunk IS NULL").select("doc_id", "text_hash", "n", "digest")
    classes = written(rows.where("n > 0").groupBy(F.col("digest").alias("node"))
                      .agg(F.min("doc_id").alias("rep")), "ngram-classes")

    sketch = spark.sparkContext.broadcast(_sketch(described))
    task, schema = _prefixes(words, percent, sketch)
    sort = ["gram", "part", "n", "node"]
    found = written(
        read.select("text").mapInArrow(task, schema).repartition("gram", "part")
        .sortWithinPartitions(*sort)
        .mapInArrow(_columns(percent), "a bigint, b bigint, shared bigint, need bigint"),
        "ngram-columns")
    sketch.unpersist()

    hubs = labelled_components(found.where("shared = 0").select("a", "b"), "ngram-clusters")
    cluster = written(hubs.withColumnRenamed("component", "cluster")
                      .join(classes.select("node"), "node", "left_semi"), "ngram-members")
    pairs = (found.where("shared > 0").groupBy("a", "b", "need")
             .agg(F.sum("shared").alias("shared")).where("shared >= need").select("a", "b"))
    n_members = cluster.count()

    def of(c: str) -> DataFrame:
        return small(cluster.select(F.col("node").alias(c), F.col("cluster").alias(f"c_{c}")),
                     24, n_members)

    pairs = written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
                    .where("NOT coalesce(c_a = c_b, false)").select("a", "b"), "ngram-pairs")
    dropped(hubs, found)

    needed = (pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
              .union(cluster.select("node")).distinct())
    wanted = written(classes.join(needed, "node", "left_semi"), "ngram-needed")
    ids = wanted.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id"))
    task, schema = _whole_sets(words)
    texts = read.join(small(ids, 16), "doc_id", "left_semi").select("text").union(
        read.where("doc_id IS NULL").select("text"))
    sets = written(texts.mapInArrow(task, schema), "ngram-sets")

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"),
                       F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"),
                        F.col("grams").alias("grams_b"))
    checked = (left.join(small(pairs, 32), "a").join(right, "b")
               .withColumn("over", overlap(F.col("grams_a"), F.col("grams_b"))))
    links = written(checked.where(
        100 * F.col("over") >= percent * (F.col("n_a") + F.col("n_b") - F.col("over")))
        .select("a", "b"), "ngram-links")
    members = written(sets.join(small(cluster, 24, n_members), "node")
                      .dropDuplicates(["node"]).select("cluster", "node", "n", "grams"),
                      "ngram-cluster-sets")
    first, second = _cluster_links(members, links, percent)
    joined = labelled_components(links.union(first).union(second), "ngram-components")
    if count_links:
        weights = written(rows.where("n > 0").groupBy(F.col("digest").alias("node"))
                          .agg(F.count(F.lit(1)).alias("weight")), "ngram-weights")
        counts = _link_counts(members, links, weights, percent)
    dropped(cluster, pairs, wanted, sets, members, links, first, second)

    group = written(joined.join(classes, "node"), "ngram-linked")
    smallest = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = written(group.join(smallest, "component").select("node", "component",
                                                               "component_id"),
                      "ngram-group-ids")
    named = written(classes.join(small(of_node, 32), "node", "left").select(
        F.col("node").alias("digest"), F.coalesce("component", "node").alias("group_id"),
        F.coalesce("component_id", "rep").alias("component_id")), "ngram-results")
    dropped(joined, group, of_node, classes)
    out = rows.join(small(named, 32), "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "group_id",
               "text_hash"]
    if count_links:
        of_class = written(weights.join(counts, "node", "left").select(
            F.col("node").alias("digest"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
            "ngram-class-links")
        dropped(weights, counts)
        out = out.join(small(of_class, 32), "digest", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*columns)


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, words: int = WORDS,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the one with the
    smallest id, then text hash (null ids last); of rows equal in both, any
    one. Rows without words are in no group and all stay, as do all columns."""
    rows = written(near_duplicate_groups(docs, percent, words, doc_id, text)
                   .where("group_id IS NOT NULL").select("doc_id", "text_hash", "group_id"),
                   "ngram-group-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = written(rows.groupBy("group_id").agg(F.min(rank).alias("kept")), "ngram-chosen")
    kept = F.col("kept") == rank
    many = rows.join(chosen, "group_id")
    twice = written(many.where(kept).groupBy("doc_id", "text_hash").count().where("count > 1")
                    .select("doc_id", "text_hash"), "ngram-repeated")
    lost = written(many.where(~kept).select("doc_id", "text_hash").distinct(), "ngram-lost")
    dropped(rows, chosen)

    gone = small(lost.select(F.col("doc_id").alias("_g_id"), F.col("text_hash").alias("_g_hash")),
                 32)
    same = (F.col(doc_id).cast("bigint").eqNullSafe(F.col("_g_id"))
            & (F.xxhash64(F.col(text)) == F.col("_g_hash")))
    left = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return left
    again = small(twice.select(F.col("doc_id").alias("_g_id"),
                               F.col("text_hash").alias("_g_hash")), 32)
    return left.join(again, same, "left_anti").unionByName(
        left.join(again, same, "left_semi").dropDuplicates([doc_id, text]))
