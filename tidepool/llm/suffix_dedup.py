"""Repeated passages by a sparse suffix array.

A passage is repeated if ``length`` words in a row occur at more than one
place. Suffixes are retained only at minimiser positions: of the ``length -
gram + 1`` word grams inside every run of ``length`` words, the one with the
smallest hash, so that both copies of a repeated run retain the same suffix.
Retained suffixes are range-partitioned and sorted by their first gram, then
by all that they cover extended left and right as far as the runs that chose
them reach, then by place; every suffix is compared with its neighbour, across
partition edges too. Where the extended content is its neighbour's, all but
the first place repeat it. Where neighbours agree in the gram but not in the
extended content, the match is extended word by word: each run around the
suffix is sorted and compared with its neighbours by itself.

The result is exact (up to equal 64-bit hashes of different runs): the words
of every run that occurred earlier - in the order of document id, then place -
are marked, and no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import (dropped, hashed_texts, lean_task, live_tables, mix64, small,
                                 texts_in, written)
from tidepool.operators.ordered import _num_partitions

LENGTH, GRAM = 50, 24

SUFFIXES = "gram bigint, content bigint, doc_id bigint, text_hash bigint, first int, last int"

# Fixed value: an odd multiplier of the rolling hash (any will do).
_BASE = 0x9E3779B97F4A7C15


class RunHashes:
    """Hashes of any runs of words of one text, from one pass of sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            words * np.cumprod(up, dtype=np.uint64)[:n], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs ``[begin, end)``; runs of different lengths differ."""
        size = (end - begin).astype(np.uint64)
        return mix64((self.sums[end] - self.sums[begin]) * self.down[begin] + size)


def sparse_suffixes(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(gram hash, content hash, first, last)`` of the retained suffixes: the
    runs of ``length`` words that chose one begin at ``first`` to ``last``;
    its content is all they cover."""
    runs = len(words) - length + 1
    if runs < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    hashes = RunHashes(words)
    at = np.arange(len(words) - gram + 1)
    grams = hashes.of(at, at + gram)
    width = length - gram + 1
    chosen = np.arange(runs) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], runs) - 1
    return grams[chosen[first]], hashes.of(first, last + length), first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _suffix_rows(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("suffixes"):
            for batch in batches:
                yield from of_batch(batch)

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, text_hash = batch.column("doc_id"), batch.column("text_hash")
        at = 0
        for _, group in hashed_texts(batch.column("text"), lower=False):
            found = [sparse_suffixes(words, length, gram) for words in group]
            owner = pa.array(np.repeat(np.arange(at, at + len(group)),
                                       [len(f[0]) for f in found]))
            at += len(group)
            g, c, first, last = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [_signed(g), _signed(c), ids.take(owner), text_hash.take(owner),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["gram", "content", "doc_id", "text_hash", "first", "last"])

    return rows


def _run_rows(length: int):
    """Every run of words that begins in the given ranges of a text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("suffixes"):
            for batch in batches:
                yield from of_batch(batch)

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, text_hash = batch.column("doc_id"), batch.column("text_hash")
        ranges = batch.column("ranges").to_pylist()
        at = 0
        for _, group in hashed_texts(batch.column("text"), lower=False):
            owner, begin, run = [], [], []
            for words in group:
                own = np.concatenate([np.arange(r["first"], r["last"] + 1)
                                      for r in ranges[at]])
                run.append(RunHashes(words).of(own, own + length))
                begin.append(own)
                owner.append(np.full(len(own), at))
                at += 1
            owner = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(run)), ids.take(owner), text_hash.take(owner),
                 pa.array(np.concatenate(begin).astype(np.int32))],
                names=["run", "doc_id", "text_hash", "first"])

    return rows


def without_ranges(text: Column, ranges: Column) -> Column:
    """Texts without the words of the given ranges (and the white space after
    each range), the words and passages removed; null where there are none."""
    @F.arrow_udf("struct<text:string,n_removed:bigint,n_passages:bigint>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with lean_task("suffixes"):
            for texts, own_ranges in batches:
                yield of_batch(texts, own_ranges)

    def of_batch(texts: pa.Array, own_ranges: pa.Array) -> pa.Array:
        word = re.compile(rb"[^\x20\x09-\x0d]+")
        out = []
        for i, t in texts_in(texts):
            own = own_ranges[i].as_py()
            if not own or t is None:
                out.append(None)
                continue
            data = t.encode("utf-8", "surrogatepass")
            starts = np.array([m.start() for m in word.finditer(data)] + [len(data)])
            change = np.zeros(len(starts), dtype=np.int64)
            for r in own:
                change[r["first"]] += 1
                change[r["end"]] -= 1
            gone = np.cumsum(change)[:-1] > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept, at = [], 0
            for b, e in zip(starts[begin].tolist(), starts[end].tolist()):
                kept.append(data[at:b])
                at = e
            kept.append(data[at:])
            out.append({"text": b"".join(kept).decode("utf-8", "surrogatepass"),
                        "n_removed": int(gone.sum()), "n_passages": len(begin)})
        return pa.array(out, type=pa.struct([
            ("text", pa.string()), ("n_removed", pa.int64()), ("n_passages", pa.int64())]))

    return cut.asNondeterministic()(text, ranges)


# --- sorted neighbours ---------------------------------------------------------

_PLACE = ("doc_id", "text_hash", "first")
_ADDED = "_pid int, _no bigint, _start boolean, _differs boolean, _again boolean, _head boolean"


def _numbers(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    """The columns as numbers, a nullable one as two."""
    out = []
    for name in names:
        column = batch.column(name)
        if column.null_count:
            out.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
            column = column.fill_null(0)
        else:
            out.append(np.zeros(len(column), dtype=np.int64))
        out.append(column.to_numpy(zero_copy_only=False).astype(np.int64))
    return out


def _compared(keys: list[str]):
    """Every row of a sorted partition with the row before: ``_start`` (other
    keys), ``_differs`` (other keys, but the same first one), ``_again`` (not
    at the first place of its keys) and ``_head`` (of the partition's first
    keys, which may go on from the partition before)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows = groups = 0
        last = lead = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, place = _numbers(batch, keys), _numbers(batch, _PLACE)
            changed = np.zeros((len(key), n), dtype=bool)
            for c, own in zip(changed, key):
                c[1:] = own[1:] != own[:-1]
            if last is not None:
                changed[:, 0] = [own[0] != x for own, x in zip(key, last)]
            start = changed.any(axis=0)
            differs = start & ~changed[:2].any(axis=0)
            if last is None:
                start[0] = True
            at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            again = np.zeros(n, dtype=bool)
            for i, own in enumerate(place):
                first = own[np.maximum(at, 0)]
                if lead is not None:
                    first = np.where(at < 0, lead[i], first)
                again |= own != first
            head = groups + np.cumsum(start) == 1
            groups += int(start.sum())
            last = [int(own[-1]) for own in key]
            if at[-1] >= 0:
                lead = [int(own[at[-1]]) for own in place]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)),
                 pa.array(np.arange(rows, rows + n)), pa.array(start), pa.array(differs),
                 pa.array(again), pa.array(head)],
                names=[*batch.schema.names, "_pid", "_no", "_start", "_differs", "_again", "_head"])
            rows += n

    return compare


def sorted_neighbours(table: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` sorted by ``keys`` and place, with ``_repeat`` (its keys occur
    at an earlier place), ``_start`` (the first row of its keys) and
    ``_differs`` (a first row whose predecessor has the same first key).

    Range partitions split any group, also one of equal rows (a row id comes
    last in the order). What a partition must know of those before it is one
    row per partition, followed in order on the driver."""
    with_ids = written(table.withColumn("_tie", F.monotonically_increasing_id()), "suffix-ids")
    order = [*keys, *_PLACE, "_tie"]
    ranged = with_ids.repartitionByRange(_num_partitions(with_ids, None), *order) \
        .sortWithinPartitions(*order).drop("_tie")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    rows = written(ranged.mapInArrow(_compared(keys), f"{fields}, {_ADDED}"), "suffix-array")
    dropped(with_ids)
    key, place = F.struct(*keys), F.struct(*_PLACE)
    edges = rows.groupBy("_pid").agg(
        F.min_by(key, "_no").alias("head"), F.max_by(key, "_no").alias("tail"),
        F.max_by(place, F.when(F.col("_start"), F.col("_no"))).alias("lead")).orderBy("_pid")
    fixes, tail, lead = [], None, None
    for e in edges.toLocalIterator():
        goes_on = tail == e["head"]
        if goes_on or (tail is not None and tail[0] == e["head"][0]):
            fixes.append((e["_pid"], goes_on, lead if goes_on else None))
        if not (goes_on and e["head"] == e["tail"]):
            lead = e["lead"]
        tail = e["tail"]
    fixed = table.sparkSession.createDataFrame(fixes, T.StructType([
        T.StructField("_fix", T.IntegerType()), T.StructField("_on", T.BooleanType()),
        T.StructField("_lead", T.StructType([table.schema[c] for c in _PLACE]))]))
    goes_on = F.coalesce("_on", F.lit(False))
    first_row = F.col("_no") == 0
    return rows.join(F.broadcast(fixed), F.col("_pid") == F.col("_fix"), "left").select(
        *table.columns,
        F.when(goes_on & F.col("_head"), ~place.eqNullSafe(F.col("_lead")))
        .otherwise(F.col("_again")).alias("_repeat"),
        (F.col("_start") & ~(first_row & goes_on)).alias("_start"),
        (F.col("_differs") | (first_row & F.col("_fix").isNotNull() & ~goes_on)).alias("_differs"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, ranges`` (a written table): for the documents
    ``(doc_id, text_hash, text)`` that repeat something, the word ranges
    (``first`` to before ``end``, they may overlap) that occurred earlier."""
    before = set(live_tables())
    suffixes = sorted_neighbours(docs.mapInArrow(_suffix_rows(length, gram), SUFFIXES),
                                 ["gram", "content"])
    repeats = suffixes.where("_repeat").select(
        "doc_id", "text_hash", "first", (F.col("last") + length).alias("end"))

    # equal grams in different contents: extended and compared run by run
    differing = written(suffixes.where("_differs").select("gram").distinct(), "suffix-differing")
    around = written(suffixes.where("_start").join(small(differing, 16), "gram", "left_semi")
                     .groupBy("doc_id", "text_hash")
                     .agg(F.collect_list(F.struct("first", "last")).alias("ranges")),
                     "runs-around")
    keyed = docs.select(F.col("doc_id").alias("_rep_id"), F.col("text_hash").alias("_rep_hash"),
                        "text")
    near = _with_ranges(keyed, around, "inner", few=True).select(
        F.col("_rep_id").alias("doc_id"), F.col("_rep_hash").alias("text_hash"), "text",
        F.col("_rep_ranges").alias("ranges"))
    runs = sorted_neighbours(near.mapInArrow(
        _run_rows(length), "run bigint, doc_id bigint, text_hash bigint, first int"), ["run"])
    run_repeats = runs.where("_repeat").select(
        "doc_id", "text_hash", "first", (F.col("first") + length).alias("end"))
    out = written(repeats.union(run_repeats).distinct().groupBy("doc_id", "text_hash")
                  .agg(F.collect_list(F.struct("first", "end")).alias("ranges")), "word-ranges")
    dropped(*[t for t in live_tables() if t not in before and t != out.scratch])
    return out


def _with_ranges(docs: DataFrame, ranges: DataFrame, how: str, few: bool) -> DataFrame:
    """``docs`` (keyed by ``_rep_id`` and ``_rep_hash``) with the ``ranges`` of
    their id and text hash as ``_rep_ranges``: a shuffle join, or with ``few``
    a broadcast join if the ranges prove small."""
    kept = ranges.select(F.col("doc_id").alias("_of_id"), F.col("text_hash").alias("_of_hash"),
                         F.col("ranges").alias("_rep_ranges"))
    if few:
        total = kept.agg(F.sum(F.size("_rep_ranges")), F.count(F.lit(1))).first()
        kept = small(kept, 1, 16 * (total[0] or 0) + 64 * total[1])
    same = ((F.col("_rep_hash") == F.col("_of_hash"))
            & F.col("_rep_id").eqNullSafe(F.col("_of_id")))
    return docs.join(kept, same, how).drop("_of_id", "_of_hash")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without repeated passages, ``n_removed`` (words)
    and ``n_passages``; all other columns and all rows stay.

    Words are ``[^\\x20\\x09-\\x0D]+``, case kept. Every run of ``length``
    words that occurred before - in a document with a smaller id, or earlier
    in the same - is removed with the white space after it; runs that overlap
    are one passage. Null ids come first in order; rows equal in id and text
    are one place (each keeps what the other has). Null and empty texts and
    texts of fewer words stay as they are. Existing columns named
    ``n_removed`` and ``n_passages`` are replaced."""
    source = docs.drop("n_removed", "n_passages")
    narrow = source.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                           F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    ranges = repeated_ranges(narrow.where(F.col("text").isNotNull()), length, gram)
    keyed = source.withColumns({"_rep_id": F.col(doc_id).cast("bigint"),
                                "_rep_hash": F.xxhash64(F.col(text))})
    joined = _with_ranges(keyed, ranges, "left", few=False)
    cleaned = joined.withColumn("_clean", without_ranges(
        F.when(F.col("_rep_ranges").isNotNull(), F.col(text)), F.col("_rep_ranges")))
    out = [F.coalesce("_clean.text", F.col(text)).alias(c) if c == text else F.col(c)
           for c in source.columns]
    return cleaned.select(
        *out, F.coalesce("_clean.n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_clean.n_passages", F.lit(0)).cast("bigint").alias("n_passages"))
