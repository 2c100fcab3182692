"""Row-level functions (Column -> Column), all JVM-side Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.parse import split_ws

# Fixed value: the end-of-time sentinel, in epoch milliseconds (the largest
# millisecond count whose microseconds fit in 64 bits).
END_OF_TIME_MS = 9_223_372_036_854_775


def end_of_time() -> Column:
    """The end-of-stream timestamp (year 294247)."""
    return F.timestamp_millis(F.lit(END_OF_TIME_MS))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- 1 -> n, 1 -> 1 projections ---------------------------------------------

def split_tokens(df: DataFrame, text: str, out: str = "token") -> DataFrame:
    """One row per whitespace-separated token of ``text`` (runs of
    whitespace collapse; no empty tokens). Other columns are kept."""
    return df.withColumn(out, F.explode(split_ws(F.col(text))))


def decode_utf8(data, strict: bool = False) -> Column:
    """Bytes -> text. ``strict`` fails the job on invalid UTF-8 (as a
    ``bytes.decode`` would); otherwise invalid bytes become U+FFFD."""
    text = _c(data).cast("string")
    return F.validate_utf8(text) if strict else F.make_valid_utf8(text)


def encode_bytes(value) -> Column:
    """A value -> the UTF-8 bytes of its text form."""
    return _c(value).cast("string").cast("binary")


def key_by(df: DataFrame, key, keep: bool = True) -> DataFrame:
    """Add ``key`` (from a column name or expression) in front of the row."""
    k = _c(key).alias("key")
    return df.select(k, *df.columns) if keep else df.select(k)


def as_int(value) -> Column:
    """``int(x)`` of text: optional sign and surrounding whitespace; NULL
    when not an integer (no decimals, no underscores) or beyond 64 bits."""
    v = _c(value).cast("string")
    ok = v.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(ok, v.try_cast("bigint"))


def as_str(value) -> Column:
    """``str(x)``: the text form of a value."""
    return _c(value).cast("string")


def as_float(value) -> Column:
    """``float(x)`` of text: digits with an optional sign, point, exponent and
    surrounding whitespace, or a spelling of infinity or not-a-number; NULL
    otherwise (``1d``, ``0x1p3`` are numbers to Java only)."""
    v = F.trim(F.regexp_replace(_c(value).cast("string"), r"^\s+|\s+$", ""))
    number = v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    word = F.lower(F.regexp_replace(v, r"^[+-]", ""))
    sign = F.when(v.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (F.when(number, v.try_cast("double"))
             .when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))
             .when(word == "nan", F.lit(float("nan"))))


def value_range(value) -> Column:
    """``range(int(v))``: ``[0, 1, ..., v-1]``, empty when ``v <= 0``."""
    v = _c(value).cast("bigint")
    return F.when(v > 0, F.sequence(F.lit(0).cast("bigint"), v - 1)) \
            .otherwise(F.array().cast("array<bigint>"))


def assign_event_time(df: DataFrame, millis: str | None = None, seconds: str | None = None,
                      out: str = "event_time") -> DataFrame:
    """Set the event-time column from epoch milliseconds (exact) or epoch
    seconds (fractional allowed)."""
    if (millis is None) == (seconds is None):
        raise ValueError("give exactly one of millis / seconds")
    t = (F.timestamp_millis(F.col(millis).cast("bigint")) if millis
         else F.timestamp_micros(F.round(F.col(seconds) * 1_000_000).cast("bigint")))
    return df.withColumn(out, t)


def _py_scalar(c: Column, dtype: str, in_list: bool) -> Column:
    if dtype == "boolean":
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))
    if dtype == "string" and in_list:  # list elements print as repr: 'abc'
        return F.concat(F.lit("'"), c, F.lit("'"))
    return c.cast("string")


def _py_text(c: Column, dtype: str) -> Column:
    """Text of a value as Python's ``%s`` renders it: lists as ``[a, b]``
    with their elements' repr (``'text'``, ``True``), booleans as
    ``True``/``False``."""
    if dtype.startswith("array<"):
        inner = dtype[len("array<"):-1]
        return F.concat(F.lit("["), F.array_join(
            F.transform(c, lambda x: _py_scalar(x, inner, True)), ", "), F.lit("]"))
    return _py_scalar(c, dtype, False)


# The two text forms below.
def format_score(key, value, value_type: str | None = None) -> Column:
    """``'user: %s, total_score: %s' % (key, value)``; ``value`` may be a
    number or a list (give ``value_type``, e.g. ``"array<bigint>"``; arrays
    render as ``[a, b, c]``)."""
    v = _c(value)
    return F.concat(F.lit("user: "), _c(key).cast("string"), F.lit(", total_score: "),
                    _py_text(v, value_type or ""))


def format_pair(key, value, value_type: str | None = None) -> Column:
    """``'%s: %s' % (key, value)``; give ``value_type`` (e.g.
    ``"array<boolean>"``) for booleans and lists."""
    return F.concat(_c(key).cast("string"), F.lit(": "), _py_text(_c(value), value_type or ""))


def random_value(seed: int | None = None) -> Column:
    """A uniform double in [0, 1)."""
    return F.rand(seed)


def multiply(data, factor: int) -> Column:
    """ASCII digits (bytes or text) -> integer x ``factor``; NULL when the
    bytes are not an integer."""
    return as_int(_c(data).cast("string")) * F.lit(factor).cast("bigint")


def path_join(parts) -> Column:
    """``os.path.join(*parts)``: parts joined by ``/``; a part starting with
    ``/`` discards everything before it; no separator is added after a part
    that already ends with ``/``."""
    p = _c(parts)

    def step(acc, b):
        return (F.when(b.startswith("/"), b)
                 .when((acc == F.lit("")) | acc.endswith("/"), F.concat(acc, b))
                 .otherwise(F.concat(acc, F.lit("/"), b)))

    return F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), p[0], step)


def is_end_of_time(event_time) -> Column:
    """True for the end-of-stream sentinel (event time at or past it)."""
    return _c(event_time) >= end_of_time()


def with_event_time(df: DataFrame, event_time: str, out: str = "is_end") -> DataFrame:
    """Expose the event time and whether it is the end-of-stream sentinel."""
    return df.withColumn(out, is_end_of_time(event_time))


def timestamp_text(t) -> Column:
    """Readable time like Python's ``str(datetime)`` (microseconds only when
    non-zero), ``'MAX'`` for the end-of-stream sentinel. Session time zone."""
    c = _c(t)
    micros = F.unix_micros(c.cast("timestamp")) % 1_000_000
    text = F.when(micros == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.when(is_end_of_time(c), F.lit("MAX")).otherwise(text)


def now_iso() -> Column:
    """The current time as ISO-8601 UTC with a ``Z`` suffix."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
