"""Input and output contracts of the operators, as Spark StructTypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A text line, as read by spark.read.text.
LINE = T.StructType([T.StructField("value", T.StringType())])

# A broker message: payload bytes, string attributes and publish time.
MESSAGE = T.StructType([
    T.StructField("data", T.BinaryType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("publish_time", T.TimestampType()),
])

# One parsed game event.
GAME_EVENT = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
])

# One work payload: a task of a job of a graph, with the outputs it wrote.
PAYLOAD = T.StructType([
    T.StructField("graphid", T.LongType()),
    T.StructField("jobtasks", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("jobid", T.LongType()),
    T.StructField("taskid", T.LongType()),
    T.StructField("output", T.ArrayType(T.StringType())),
])

# An error carried as data (dead-letter output).
ERROR = T.StructType([
    T.StructField("error_class", T.StringType()),
    T.StructField("message", T.StringType()),
])


def require_columns(df: DataFrame, *names: str, where: str = "input") -> None:
    """Fail at build time, not at run time, when a contract column is missing."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"{where} lacks column(s) {missing}; has {df.columns}")


def require_schema(df: DataFrame, schema: T.StructType, where: str = "input") -> None:
    """Check names and types of a contract (extra columns are allowed)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in fields:
            raise ValueError(f"{where} lacks column {f.name!r}")
        if fields[f.name] != f.dataType:
            raise TypeError(
                f"{where}.{f.name} is {fields[f.name].simpleString()}, "
                f"expected {f.dataType.simpleString()}")
