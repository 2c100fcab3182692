"""Importance resampling towards a target distribution.

Texts are described by the counts of their word n-grams, hashed into buckets.
A bucket's gain is the log ratio of its share among the target's n-grams to
its share among the source's; a document's weight is the mean gain of its
n-grams; documents are drawn without replacement by weight plus Gumbel noise
from a hash of their id, so the draw is the same however the rows are dealt.

The n-grams of a batch are interned in an open-addressed numpy table under
their xxhash64 keys; equal keys are told apart by their bytes. A slot stores
the bucket and the count of its n-gram; the slot ids of the occurrences gather
the gains.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import (array_slices, lean_task, piece_batches, sums_by_length,
                                 written)
from tidepool.operators.ordered import number_rows

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SALT = 10_000, 2, 20, 25, "7"
# Words whose n-grams are interned together.
TABLE_WORDS = 200_000
# Scores are in thousandths.
UNIT = 1_000


def _word_table() -> bytes:
    """Bytes of words (digits, a-z, all of non-ASCII characters) as they are,
    all others as a space."""
    return bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                 for b in range(256))


def lowered_words(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """``(place, words)`` of every text: A-Z as a-z, words (runs of digits,
    letters and non-ASCII characters) parted by spaces. Null: none."""
    table = _word_table()
    for first, part in array_slices(texts):
        data = pc.cast(pc.ascii_lower(pc.fill_null(part, "")), pa.binary())
        for place, text in enumerate(data.to_pylist(), start=first):
            yield place, text.translate(table)


def word_batches(texts: pa.Array) -> Iterator[tuple]:
    """``(words, owners, lengths)`` of the texts, a bounded number of words at
    a time; a very long text is spread over several batches."""
    return piece_batches(lowered_words(texts), bytes.split, re.compile(rb"[^ ]+").finditer,
                         TABLE_WORDS)


class GramTable:
    """N-grams of one batch, interned: ``slot[i]`` is the place of occurrence
    i; ``gram``, ``bucket`` and ``count`` are stored per place (``gram`` is -1
    at empty ones)."""

    def __init__(self, grams: list[bytes], buckets: int):
        import xxhash
        n = len(grams)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n)
        length = np.fromiter(map(len, grams), np.int64, n)
        begin = np.cumsum(length) - length
        # zeros after the last n-gram: eight bytes are read at a time
        text = np.frombuffer(b"".join(grams) + bytes(8), dtype=np.uint8)
        size = 1 << max(3, int(2 * n - 1).bit_length())
        mask = np.uint64(size - 1)
        self.gram = np.full(size, -1, dtype=np.int64)
        self.slot = np.zeros(n, dtype=np.int64)
        at = (keys & mask).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            here = at[todo]
            free = self.gram[here] < 0
            # of the n-grams that want one empty place, the last written has it
            self.gram[here[free]] = todo[free]
            held = self.gram[here]
            same = keys[held] == keys[todo]
            same[same] = _equal(text, begin, length, held[same], todo[same])
            self.slot[todo[same]] = here[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, dtype=np.int64)
        used = np.flatnonzero(self.gram >= 0)
        self.bucket[used] = [zlib.crc32(grams[g]) % buckets for g in self.gram[used].tolist()]

    def bucket_counts(self, buckets: int) -> np.ndarray:
        used = self.gram >= 0
        return np.bincount(self.bucket[used], self.count[used], buckets).astype(np.int64)


def _equal(text: np.ndarray, begin: np.ndarray, length: np.ndarray, a: np.ndarray,
           b: np.ndarray) -> np.ndarray:
    """Whether n-grams ``a[i]`` and ``b[i]`` are the same bytes."""
    same = (length[a] == length[b])
    other = np.flatnonzero(same & (a != b))
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    done = 0
    while len(other):
        x, y = a[other], b[other]
        rest = length[x] - done
        # of a last piece of fewer than eight bytes the low ones are compared
        shift = (8 * np.clip(8 - rest, 0, 8)).astype(np.uint64)
        differ = ((words[begin[x] + done] ^ words[begin[y] + done]) << shift) != 0
        same[other[differ]] = False
        other = other[~differ & (rest > 8)]
        done += 8
    return same


def gram_batches(texts: pa.Array, longest: int) -> Iterator[tuple]:
    """``(grams, owners, lengths, n_words)``: all runs of 1 to ``longest``
    words (joined by a space) of the texts, owner after owner; a text may go
    on in the next batch, its runs across the edge come with the later one."""
    last_owner, tail = None, []
    for words, owners, lengths in word_batches(texts):
        grams, sizes = [], []
        at = 0
        for owner, n in zip(owners, lengths):
            before = tail if owner == last_owner else []
            own = [*before, *words[at:at + n]]
            at += n
            own_grams = own[len(before):]
            for k in range(2, longest + 1):
                # runs that end in a word of this batch
                first = max(0, len(before) - k + 1)
                own_grams += [b" ".join(own[i:i + k])
                              for i in range(first, len(own) - k + 1)]
            grams += own_grams
            sizes.append(len(own_grams))
            last_owner, tail = owner, own[-(longest - 1):] if longest > 1 else []
        yield grams, owners, sizes, lengths


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS,
                  longest: int = LONGEST) -> np.ndarray:
    """How often the n-grams of each bucket occur in all texts: a row per
    bucket and task is added up by Spark, and a number per bucket returned."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("importance"):
            total = np.zeros(buckets, dtype=np.int64)
            for batch in batches:
                for grams, *_ in gram_batches(batch.column(0), longest):
                    if grams:
                        total += GramTable(grams, buckets).bucket_counts(buckets)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                             names=["bucket", "n"])

    found = (df.select(F.col(text).cast("string").alias("text"))
             .mapInArrow(counts, "bucket int, n bigint")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of every bucket."""
    b = len(source)
    all_s, all_t = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(UNIT * math.log(((t + 1.0) * all_s) / ((s + 1.0) * all_t)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(df: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST) -> Column:
    """A struct column of ``df``: ``n_words``, ``n_features`` and ``weight``
    (the floored mean gain; 0 without n-grams) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(gains)

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("importance"):
            gain = shared.value
            for batch in batches:
                n_words, n, total = np.zeros((3, len(batch)), dtype=np.int64)
                for grams, owners, sizes, lengths in gram_batches(batch, longest):
                    if not grams:
                        continue
                    table = GramTable(grams, len(gain))
                    of_slot = gain[table.bucket]
                    np.add.at(n_words, owners, lengths)
                    np.add.at(n, owners, sizes)
                    np.add.at(total, owners, sums_by_length(of_slot[table.slot], sizes))
                yield pa.StructArray.from_arrays(
                    [pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["n_words", "n_features", "weight"])

    return weighed.asNondeterministic()(F.col(text).cast("string"))


def gumbel(doc_id: Column, salt: str = SALT) -> Column:
    """Noise in thousandths from a hash of the id (a null id as no text)."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT,
                        min_words: int = MIN_WORDS, buckets: int = BUCKETS,
                        longest: int = LONGEST, salt: str = SALT, doc_id: str = "doc_id",
                        text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row;
    ``rank`` (1, 2, ...) is not null for the drawn ones: the ``percent`` of
    the rows of at least ``min_words`` words with the highest scores, ties to
    the smaller id (null ids first, then the larger weight).

    Words are runs of digits, a-z and non-ASCII characters after lower-casing
    A-Z. Null and empty texts have no n-grams and weight 0. Repeated rows are
    each scored and may each be drawn. Other columns are not read; an empty
    target leaves only the noise and the rarity in the source; empty documents
    give an empty result. Two scans of the texts, one narrow range sort of the
    rows to rank (no row order in one task), a number per bucket on the
    driver."""
    gains = bucket_gains(bucket_counts(docs, text, buckets, longest),
                         bucket_counts(target, target_text, buckets, longest))
    weighed = docs.select(F.col(doc_id).alias("doc_id"),
                          weigh(docs, gains, text, longest).alias("_w"))
    scored = written(weighed.select(
        "doc_id", "_w.n_words", "_w.n_features", "_w.weight",
        (F.col("_w.weight") + gumbel(F.col("doc_id"), salt)).cast("bigint").alias("score")),
        "importance-scores")
    able = F.col("n_words") >= F.lit(min_words)
    drawn = scored.where(able).count() * percent // 100
    ranked = number_rows(
        scored.where(able).withColumn("_all", F.lit(0)), ["_all"],
        [-F.col("score"), F.col("doc_id"), -F.col("weight"), F.col("n_features")],
        out="rank", hot_key_rows=0)
    rank = F.when(F.col("rank") <= F.lit(drawn), F.col("rank"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).drop("_all").unionByName(rest)
