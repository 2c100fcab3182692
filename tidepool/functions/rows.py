"""One-to-many row functions with a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepool.contracts import require_columns

# Rows of an output batch, and input rows held as Python objects at once.
BATCH_ROWS, SLICE_ROWS = 10_000, 500


def flat_map(df: DataFrame, fn: Callable[..., Iterable[Sequence]], columns: Sequence[str],
             schema: T.StructType | str, keep: Sequence[str] = (), args: Sequence = (),
             batch_rows: int = BATCH_ROWS, **kwargs) -> DataFrame:
    """``fn(*values of columns, *args, **kwargs)`` for every row of ``df``; it
    yields any number of tuples, each a row of ``schema`` behind the ``keep``
    columns of its input row. Extra arguments are plain Python values.

    Rows travel in Arrow batches; the output of a row is cut into batches of
    ``batch_rows``, so a row may yield more than memory holds. NULLs reach
    ``fn`` as None. Where SQL has an expression for it, take that instead:
    this is a Python call per row."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    require_columns(df, *columns, *keep, where="flat_map")
    clash = sorted(set(keep) & set(schema.names))
    if clash:
        raise ValueError(f"columns both kept and yielded: {', '.join(clash)}")
    if batch_rows < 1:
        raise ValueError("batch_rows must be 1 or more")
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(schema)]
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                yield from of_slice(batch.slice(first, SLICE_ROWS))

    def of_slice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            kept = batch.select(list(keep)).take(pa.array(owner, pa.int64()))
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*keep, *names])

        owner, out = [], []
        values = [batch.column(c).to_pylist() for c in columns]
        for i, own in enumerate(zip(*values)):
            for row in fn(*own, *args, **kwargs):
                owner.append(i)
                out.append(row)
                if len(out) >= batch_rows:
                    yield made()
                    owner, out = [], []
        if out:
            yield made()

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(
        rows, T.StructType([*[df.schema[c] for c in keep], *schema.fields]))
