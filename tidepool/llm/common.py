"""Helpers shared by the operators: bounded text batches, per-process memos,
word hashes, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import dropped, live_tables, written  # noqa: F401

# A text longer than this is split into pieces chunk by chunk.
LONG_CHARS = 4_000_000
# Pieces (pre-tokens, words) held at once by a task.
BATCH_PIECES = 600_000
# Bytes of text held as Python strings at once (one text may be longer).
SLICE_BYTES = 3 << 20
# A table is broadcast only if a count shows it to be below this many bytes.
BROADCAST_BYTES = 24 << 20


def per_process(key, build: Callable):
    """``build()`` once per Python worker process. Task code is shipped by
    value, so module globals do not outlive a task; this store does."""
    memo = _process_store().__dict__.setdefault("memo", {})
    if key not in memo:
        memo[key] = build()
    return memo[key]


def _process_store():
    return sys.modules.setdefault("_llm_process_memo", types.ModuleType("_llm_process_memo"))


@contextlib.contextmanager
def lean_task(operator: str):
    """Around the work of a task: workers are reused, so what another
    operator remembered is forgotten first, and freed memory goes back to the
    system at the end."""
    store = _process_store().__dict__
    if store.get("operator") != operator:
        store["operator"] = operator
        store.pop("memo", None)
    try:
        yield
    finally:
        gc.collect()
        release_memory()


def release_memory() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_file(spark: SparkSession, path: str):
    """The bytes of a vocabulary file (about 2 MB), read on the driver and
    broadcast, with a key for :func:`per_process`."""
    data = Path(path).read_bytes()
    return spark.sparkContext.broadcast(data), (len(data), zlib.crc32(data))


def array_slices(texts: pa.Array, max_bytes: int | None = None
                 ) -> Iterator[tuple[int, pa.Array]]:
    """``(first, slice)``: slices of about ``max_bytes`` of text."""
    max_bytes = max_bytes or SLICE_BYTES
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    first = 0
    while first < len(texts):
        done = end[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(end, done + max_bytes, side="right")))
        last = min(last, first + 20_000)
        yield first, texts.slice(first, last - first)
        first = last


def text_slices(texts: pa.Array, max_bytes: int | None = None) -> Iterator[tuple[int, list]]:
    """``(first, texts[first:...])`` in Python strings, slice by slice, so that
    a large Arrow batch is never all Python objects."""
    for first, part in array_slices(texts, max_bytes):
        yield first, part.to_pylist()


def texts_in(texts: pa.Array) -> Iterator[tuple[int, str | None]]:
    """``(place, text)`` of every text, through :func:`text_slices`."""
    for first, group in text_slices(texts):
        yield from enumerate(group, start=first)


def piece_batches(segments, find_all: Callable, find_iter: Callable,
                  limit: int = BATCH_PIECES) -> Iterator[tuple]:
    """``(pieces, owners, lengths)``: the pieces of ``(owner, text)`` segments,
    at most about ``limit`` at a time and always in order; a very long
    text is spread over several batches."""
    pieces, owners, lengths = [], [], []
    for owner, text in segments:
        if len(text) <= LONG_CHARS:
            found = find_all(text)
            pieces += found
            owners.append(owner)
            lengths.append(len(found))
            if len(pieces) >= limit:
                yield pieces, owners, lengths
                pieces, owners, lengths = [], [], []
            continue
        if pieces:
            yield pieces, owners, lengths
            pieces, owners, lengths = [], [], []
        matches = find_iter(text)
        while chunk := [m.group() for m in itertools.islice(matches, limit)]:
            yield chunk, [owner], [len(chunk)]
    if owners:
        yield pieces, owners, lengths


class CodeBook:
    """A bounded memo from distinct pieces to rows of per-piece results.

    ``encode(new_pieces)`` is called once per piece not yet known; when more
    than ``limit`` pieces are known the memo starts anew."""

    def __init__(self, encode: Callable, limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.rows: dict = {}
        self.results = None

    def rows_of(self, pieces: list) -> np.ndarray:
        """The result row of every piece (repeats allowed)."""
        self._learn(set(pieces))
        return np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))

    def rows_of_array(self, pieces: pa.Array) -> np.ndarray:
        """The same for an Arrow array; only its distinct values become
        Python objects."""
        codes = pieces.dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        self._learn(distinct)
        rows = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))
        return rows[codes.indices.to_numpy(zero_copy_only=False)]

    def _learn(self, distinct) -> None:
        known = self.rows
        new = [p for p in distinct if p not in known]
        if len(known) + len(new) > self.limit:
            known = self.rows = {}
            self.results, new = None, list(distinct)
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.results = self.encode(new, self.results)


def sums_by_length(values: np.ndarray, lengths: Sequence[int]) -> np.ndarray:
    """Sums over consecutive runs of the given lengths (0 allowed)."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[ends - np.asarray(lengths, dtype=np.int64)]


# --- word hashes -------------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (``[^\\x20\\x09-\\x0D]+``) of the texts as one binary array, and
    how many each text has; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(
        zero_copy_only=False), dtype=np.int64)])
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).cast(pa.binary()), np.diff(upto[begin])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once."""
    import xxhash
    codes = words.dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, codes.dictionary.to_pylist()),
                    np.uint64, len(codes.dictionary))
    return h[codes.indices.to_numpy(zero_copy_only=False)]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (none if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + h[i:i + len(out)] + np.uint64(i + 1))
    return out


def hashed_texts(texts: pa.Array, lower: bool) -> Iterator[tuple]:
    """``(first, [hashes of the words of texts[first]], ...)``, slice by slice;
    with ``lower``, of the words with A-Z as a-z."""
    for first, part in array_slices(texts):
        words, counts = split_words(pc.ascii_lower(part) if lower else part)
        h = word_hashes(words)
        ends = np.cumsum(counts)
        yield first, [h[e - n:e] for e, n in zip(ends, counts)]


# --- links in a block ----------------------------------------------------------

class Forest:
    """Union-find over the vectors or documents of a block; links are given
    as boolean matrices and only a spanning forest of them comes out."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return int(i)

    def join(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> None:
        """Unite member ``rows[i]`` with ``cols[j]`` wherever ``linked[i, j]``."""
        r = np.flatnonzero(linked.any(axis=1))
        if not len(r):
            return
        c = np.flatnonzero(linked.any(axis=0))
        rows, cols, linked = rows[r], cols[c], linked[np.ix_(r, c)]
        none = len(self.parent)
        # the smallest label in reach, passed to and fro until it settles
        row_label = np.array([self.root(i) for i in rows.tolist()])
        col_label = np.array([self.root(i) for i in cols.tolist()])
        while True:
            to_col = np.minimum(col_label, np.where(linked, row_label[:, None], none).min(axis=0))
            to_row = np.minimum(row_label, np.where(linked, to_col[None, :], none).min(axis=1))
            if (to_col == col_label).all() and (to_row == row_label).all():
                break
            row_label, col_label = to_row, to_col
        for i, label in zip([*rows.tolist(), *cols.tolist()],
                            [*row_label.tolist(), *col_label.tolist()]):
            x, y = self.root(i), self.root(label)
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Members that are not roots, and their roots."""
        root = np.array([self.root(i) for i in range(len(self.parent))], dtype=np.int64)
        member = np.flatnonzero(root != np.arange(len(root)))
        return member, root[member]


# --- tables ------------------------------------------------------------------

def small(df: DataFrame, bytes_per_row: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is below
    ``BROADCAST_BYTES``, else as it is (a shuffle join). ``df`` should be a
    written table, so that counting it is cheap."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * bytes_per_row <= BROADCAST_BYTES else df


def labelled_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` (both of one
    type); component is the smallest node reachable.

    Every round hooks each node to its smallest neighbour (a grouped
    minimum), follows these pointers to their roots by doubling, and goes on
    with the edges between different roots: the nodes left at least halve, so
    rounds grow with the logarithm of the nodes. No group is ever gathered,
    and joins are between written tables, so that a node with very many edges
    is split as a skewed join. Self edges and nulls are ignored."""
    e = written(edges.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), name)
    label = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("v")), name)
        moved = True
        while moved:
            up = root.select(F.col("u").alias("v"), F.col("v").alias("w"))
            step = written(root.select("u", "v").join(up, "v").select(
                "u", F.col("w").alias("v"), (F.col("v") != F.col("w")).alias("moved")), name)
            moved = not step.where("moved").isEmpty()
            dropped(root)
            root = step
        ru = root.select("u", F.col("v").alias("ru"))
        rv = root.select(F.col("u").alias("v"), F.col("v").alias("rv"))
        rest = written(e.join(ru, "u").join(rv, "v").where(F.col("ru") != F.col("rv"))
                       .select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v"))
                       .distinct(), name)
        done = rest.isEmpty()
        if label is None:
            label = root
        else:
            up = root.select(F.col("u").alias("v"), F.col("v").alias("w"))
            next_label = written(label.select("u", "v").join(up, "v", "left")
                                 .select("u", F.coalesce("w", "v").alias("v")), name)
            dropped(label, root)
            label = next_label
        dropped(e)
        e = rest
        if done:
            dropped(e)
            out = label.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.scratch = label.scratch
            return out
