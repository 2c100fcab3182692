"""Vector code compression: integer product codes through per-dimension value
dictionaries.

Components become integers, vectors are cut into equal parts and every part is
named by the nearest entry of its position's codebook. Integers repeat a great
deal, so distances are not computed vector by vector: per dimension, the
distinct integers of a batch form a dictionary, the squared differences of
every distinct integer to all entries are tabulated once, and the distances of
a part are gathers from these tables by dictionary code and adds.

Everything is exact integer arithmetic. A round of training is one scan: every
task returns the sums and counts per part and entry, Spark adds them up, and
only these - as many numbers as the codebooks have - reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import lean_task, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors whose distances are held at once.
SLICE_ROWS = 2_048


def usable(embedding: Column) -> Column:
    """True for a vector that is not null and holds no null or non-finite
    component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def _largest(size: int) -> int:
    """Up to this size integers differ so that ``size`` squares fit a long."""
    return math.isqrt((1 << 62) // max(1, size)) // 2


def _integers(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a batch of vectors of one length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(lengths) and not (lengths == size).all():
        raise ValueError(f"vectors of different lengths: {size} and "
                         f"{int(lengths[lengths != size][0])}")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(values * scale)
    largest = _largest(size)
    if len(values) and np.abs(values).max() > largest:
        raise ValueError(f"a component times {scale} is beyond {largest}: squared distances "
                         "would not fit a long; use a smaller scale")
    return values.astype(np.int64).reshape(len(vectors), size)


class Codebooks:
    """``entries[part]``: an integer matrix, one row per entry. All parts are
    equally wide and have the same number of entries (maybe none)."""

    def __init__(self, entries: list[np.ndarray], scale: int = SCALE):
        self.entries, self.scale = entries, scale

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def digest(self) -> str:
        """Hex SHA-256 of all components by part, entry and place in it."""
        flat = np.concatenate([e.ravel() for e in self.entries])
        return hashlib.sha256(",".join(map(str, flat.tolist())).encode()).hexdigest()

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, errors)``, both (rows, parts): the nearest entry of every
        part (ties to the lower index) and its squared distance."""
        codes = np.zeros((len(rows), self.parts), dtype=np.int64)
        errors = np.zeros((len(rows), self.parts), dtype=np.int64)
        for part, entries in enumerate(self.entries):
            distance = np.zeros((len(rows), len(entries)), dtype=np.int64)
            for place in range(self.width):
                values, code = np.unique(rows[:, part * self.width + place], return_inverse=True)
                table = (values[:, None] - entries[None, :, place]) ** 2
                distance += table[code]
            nearest = distance.argmin(axis=1)
            codes[:, part] = nearest
            errors[:, part] = distance[np.arange(len(rows)), nearest]
        return codes, errors

    def moved(self, sums: list[np.ndarray], counts: np.ndarray) -> Codebooks:
        """Entries replaced by the floored mean of their parts; unused ones
        stay."""
        out = []
        for entries, total, n in zip(self.entries, sums, counts):
            used = n > 0
            new = entries.copy()
            new[used] = total[used] // n[used, None]
            out.append(new)
        return Codebooks(out, self.scale)

    def decoded(self, code: str) -> np.ndarray:
        """The vector a code string stands for (components divided by scale)."""
        at = [int(code[2 * p:2 * p + 2], 16) for p in range(self.parts)]
        return np.concatenate([e[i] for e, i in zip(self.entries, at)]) / self.scale


def _slices(vectors: pa.Array, books: Codebooks) -> Iterator[np.ndarray]:
    for first in range(0, len(vectors), SLICE_ROWS):
        yield _integers(vectors.slice(first, SLICE_ROWS), books.parts * books.width, books.scale)


def _first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the ``entries`` rows of smallest id (a bounded number)."""
    first = (kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)
             .select(F.col("vector").cast("array<double>").alias("vector")).toArrow())
    if not first.num_rows:
        return None
    vectors = first["vector"].combine_chunks()
    size = len(vectors[0])
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    rows = _integers(vectors, size, scale)
    return Codebooks(list(np.split(rows, parts, axis=1)), scale)


def _sums(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, entries to their means."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_task("vector-codes"):
            own = shared.value
            n_entries, width = len(own.entries[0]), own.width
            count = np.zeros((own.parts, n_entries), dtype=np.int64)
            total = np.zeros((own.parts, width, n_entries), dtype=np.int64)
            for batch in batches:
                for rows in _slices(batch.column("vector"), own):
                    codes, _ = own.assign(rows)
                    for p in range(own.parts):
                        count[p] += np.bincount(codes[:, p], minlength=n_entries)
                        order = np.argsort(codes[:, p], kind="stable")
                        first = np.flatnonzero(np.diff(codes[order, p], prepend=-1))
                        total[p][:, codes[order[first], p]] += np.add.reduceat(
                            rows[order, p * width:(p + 1) * width], first, axis=0).T
            part, entry = np.nonzero(count)
            for place in range(width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
                     pa.array(np.full(len(part), place, np.int32)),
                     pa.array(total[part, place, entry]), pa.array(count[part, entry])],
                    names=["part", "entry", "place", "total", "n"])

    found = (kept.select("vector").mapInArrow(
        totals, "part int, entry int, place int, total bigint, n bigint")
        .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"),
                                               F.sum("n").alias("n")).toArrow())
    part, entry, place, total, n = (found[c].to_numpy() for c in
                                    ("part", "entry", "place", "total", "n"))
    sums = np.zeros((books.parts, len(books.entries[0]), books.width), dtype=np.int64)
    counts = np.zeros((books.parts, len(books.entries[0])), dtype=np.int64)
    sums[part, entry, place] = total
    counts[part, entry] = n
    return books.moved(list(sums), counts)


def _kept(df: DataFrame, vec_id: str, embedding: str, label: str | None) -> DataFrame:
    vector = F.col(embedding)
    return df.where(usable(vector)).select(
        F.col(vec_id).alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        vector.cast("array<double>").alias("vector"))


def fit_codebooks(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id",
                  embedding: str = "embedding") -> Codebooks | None:
    """Codebooks of the usable vectors of ``df`` (None if there are none):
    started from the ``entries`` smallest ids, moved ``rounds`` times over all
    rows."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    kept = _kept(df, vec_id, embedding, None)
    books = _first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books is not None and books.width else 0):
        books = _sums(kept, books)
    return books


def encode_vectors(kept: DataFrame, books: Codebooks, vector: str = "vector") -> Column:
    """A struct column of ``kept`` (whose vectors are all usable): ``code``,
    two hex digits a part, and ``error``, the squared distance of the vector's
    integers to what the code stands for."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<code:string,error:bigint>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean_task("vector-codes"):
            own = shared.value
            for batch in batches:
                code, error = [], [np.zeros(0, np.int64)]
                for rows in _slices(batch, own):
                    codes, errors = own.assign(rows)
                    code += [row.tobytes().hex() for row in codes.astype(np.uint8)]
                    error.append(errors.sum(axis=1))
                yield pa.StructArray.from_arrays(
                    [pa.array(code, pa.string()), pa.array(np.concatenate(error))],
                    names=["code", "error"])

    return encode.asNondeterministic()(F.col(vector).cast("array<double>"))


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable
    vector; rows whose vector is null or holds null or non-finite components
    are left out.

    ``error`` is the squared distance in integer units, ``label_error`` its
    sum over the rows of an equal label (null labels together). Codebooks
    start from the smallest ids, ascending: null ids last, equal ids in the
    order of their vectors; fewer rows than entries give fewer entries. Rows
    may repeat, each gets its own result. Vectors of different lengths, of a
    length that ``parts`` does not divide, or with a component so large that
    squared distances do not fit a long are an error that says so. Other columns are
    not read; an empty table gives an empty result. ``rounds + 2`` scans of
    the vectors; the codes are written once."""
    books = fit_codebooks(df, parts, entries, rounds, scale, vec_id, embedding)
    kept = _kept(df, vec_id, embedding, label)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"),
                           F.lit("").alias("codebooks_sha256")).limit(0)
    coded = written(kept.select("vec_id", "label", encode_vectors(kept, books).alias("_c"))
                    .select("vec_id", "label", "_c.code", "_c.error"), "vector-codes")
    of_label = written(coded.groupBy(F.col("label").alias("_label")).agg(
        F.sum("error").alias("label_error")), "label-errors")
    return coded.join(small(of_label, 64), F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))
